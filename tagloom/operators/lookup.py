"""Lookups: the joins between tokens, lexicons and tag tables.

Lexicons grow with the corpus, so nothing here forces a broadcast: the planner
broadcasts a side only when statistics prove it small, and sorts and merges else.
Forms repeat, so lookups run over distinct forms and join back by form.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: More than there are tags.
SIZE = 1 << 16


def lexicon_exact(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, tag, weight: entries of exactly that form, weighted by their counts."""
    return forms.join(lexicon, "form").select("form", "tag", F.greatest(F.col("n"), F.lit(1)).cast("double").alias("weight"))


def lexicon_lower(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """As above for forms without an exact entry, by their lower case, at a tenth.
    Of entries that collide in lower case the most frequent spelling wins, then the first."""
    rest = forms.join(lexicon.select("form").distinct(), "form", "left_anti")
    spelled = lexicon.groupBy("form").agg(F.sum("n").alias("freq")).withColumn("low", F.lower("form"))
    w = Window.partitionBy("low").orderBy(F.desc("freq"), "form")
    best = spelled.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("low", F.col("form").alias("entry"))
    hit = rest.withColumn("low", F.lower("form")).join(best, "low")
    lex = lexicon.select(F.col("form").alias("entry"), "tag", "n")
    return hit.join(lex, "entry").select("form", "tag", (F.greatest(F.col("n"), F.lit(1)) * 0.1).alias("weight"))


def ending_lookup(forms: DataFrame, endings: DataFrame, longest: int = 6, retry: int = 2, base: float = 2.0) -> DataFrame:
    """form, ending, tag, weight: entries of the longest known suffixes, at most
    retry + 1 of them; the k-th weighs count * base ** -k."""
    sizes = F.sequence(F.least(F.lit(longest), F.char_length("form")), F.lit(1), F.lit(-1))
    s = forms.select("form", F.explode(F.transform(sizes, lambda k: F.right("form", k))).alias("ending"))
    cells = endings.groupBy("ending").agg(F.collect_list(F.struct("tag", "n")).alias("ts"))
    w = Window.partitionBy("form").orderBy(F.desc(F.char_length("ending")))
    hits = s.join(cells, "ending").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= retry + 1)
    t = hits.select("form", "ending", "k", F.explode("ts").alias("t"))
    return t.select("form", "ending", "t.tag", (F.col("t.n") * F.pow(F.lit(base), -F.col("k"))).alias("weight"))


def _cells(lexicon: DataFrame) -> DataFrame:
    """form, ts (array of tag, w), freq: the entries of each form in one row."""
    e = lexicon.groupBy("form", "tag").agg(F.sum("n").alias("n"))
    t = F.struct("tag", F.greatest(F.col("n"), F.lit(1)).cast("double").alias("w"))
    return e.groupBy("form").agg(F.collect_list(t).alias("ts"), F.sum("n").alias("freq"))


def _known(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, ts, source: exact entries, or else lower-case ones, or nulls; written once."""
    cells = _cells(lexicon)
    low = cells.groupBy(F.lower("form").alias("_l")).agg(F.min_by("ts", F.struct(-F.col("freq"), "form")).alias("_ts"))
    f = forms.join(cells.select("form", "ts"), "form", "left").join(low, (F.lower("form") == F.col("_l")) & F.col("ts").isNull(), "left")
    tenth = F.transform("_ts", lambda t: F.struct(t["tag"].alias("tag"), (t["w"] * 0.1).alias("w")))
    return stored(f.select("form", F.coalesce("ts", tenth).alias("ts"), F.when(F.col("ts").isNotNull(), "lexicon").when(F.col("_ts").isNotNull(), "lower").alias("source")), "lattice")


def evidence(forms: DataFrame, lexicon: DataFrame, endings: DataFrame, longest: int = 7) -> DataFrame:
    """form, cell: what ``candidate_lattice`` weighs, before it is weighed: an array of (size, tag, w), with size 0 for
    exact or lower-case entries, else the entries of each known suffix of at most ``longest``, the longest first; empty
    where there is neither. The candidates for any length, retry and base follow from it in the row."""
    f = _known(forms, lexicon)
    known = f.filter("source IS NOT NULL").select("form", F.transform("ts", lambda t: F.struct(F.lit(0).alias("size"), t["tag"].alias("tag"), t["w"].alias("w"))).alias("cell"))
    rest = f.filter("source IS NULL").select("form")
    entry = lambda k, t: F.struct((-k).alias("size"), t["tag"].alias("tag"), t["w"].alias("w"))
    cell = F.flatten(F.transform("h", lambda h: F.transform(h["ts"], lambda t: entry(h["k"], t))))
    rest = rest.join(_by_suffix(rest, endings, longest), "form", "left").select("form", F.coalesce(cell, F.array().cast("array<struct<size:int,tag:string,w:double>>")).alias("cell"))
    return known.unionByName(rest)


def _by_suffix(forms: DataFrame, endings: DataFrame, longest: int) -> DataFrame:
    """form, h: the entries ``ts`` of each known suffix of at most ``longest``, the longest first (k: its size, negative)."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("form")))
    s = forms.filter("form <> ''").select("form", F.explode(F.transform(sizes, lambda k: F.right("form", k))).alias("ending"))
    cells = endings.groupBy("ending").agg(F.array_sort(F.collect_list(F.struct("tag", F.col("n").cast("double").alias("w")))).alias("ts"))
    return s.join(cells, "ending").groupBy("form").agg(F.array_sort(F.collect_list(F.struct((-F.char_length("ending")).alias("k"), "ts"))).alias("h"))


def evidence_in_row(cells: DataFrame, endings: DataFrame, longest: int = 6, most: int = 3) -> DataFrame:
    """As ``evidence``, for distinct forms that come with their own entries: form, ts (an array of tag, a number, and w; null
    if there is none), freq. Only forms without entries are looked up, by lower case and then by suffix. cell is flat, size *
    ``SIZE`` + tag and w of each entry in turn, and has the ``most`` longest known suffixes: enough for a retry under it."""
    pairs = lambda size, ts, share=1.0: F.flatten(F.transform(ts, lambda t: F.array((size * SIZE + t["tag"]).cast("double"), t["w"] * share)))
    known = cells.filter("ts IS NOT NULL")
    rest = cells.filter("ts IS NULL").select("form", F.lower("form").alias("_l"))
    spelled = known.select(F.lower("form").alias("_l"), "form", "ts", "freq").join(rest.select("_l"), "_l", "left_semi")
    low = spelled.groupBy("_l").agg(F.min_by("ts", F.struct(-F.col("freq"), "form")).alias("_ts"))
    rest = stored(rest.join(low, "_l", "left").select("form", pairs(F.lit(0), F.col("_ts"), 0.1).alias("cell")), "lattice")
    left = rest.filter("cell IS NULL").select("form")
    h = F.flatten(F.transform(F.slice("h", 1, most), lambda h: pairs(-h["k"], h["ts"])))
    left = left.join(_by_suffix(left, endings, longest), "form", "left").select("form", F.coalesce(h, F.array().cast("array<double>")).alias("cell"))
    return known.select("form", pairs(F.lit(0), F.col("ts")).alias("cell")).unionByName(rest.filter("cell IS NOT NULL")).unionByName(left)


def candidate_lattice(
    forms: DataFrame, lexicon: DataFrame, endings: DataFrame, types: DataFrame, longest: int = 6, retry: int = 2, base: float = 2.0
) -> DataFrame:
    """form, tag, p, source: candidates of each form, summing to 1: exact entries, or
    else lower-case ones, or else endings, or else the prior of types.

    Entries are gathered to one row a form; forms meet them in two joins, and only forms
    that neither finds are cut into endings. That table is written once (a job runs while
    this is built), then read by both parts.
    """
    f = _known(forms, lexicon)
    rest = f.filter("source IS NULL").select("form")
    by_ending = ending_lookup(rest, endings, longest, retry, base).groupBy("form", "tag").agg(F.sum("weight").alias("w"))
    by_ending = by_ending.groupBy("form").agg(F.collect_list(F.struct("tag", "w")).alias("ts"))
    shown = types.agg(F.collect_list(F.struct("tag", F.col("n_types").cast("double").alias("w"))).alias("_types"))  # one row: tags only
    rest = rest.join(by_ending, "form", "left").crossJoin(F.broadcast(shown))
    rest = rest.select("form", F.coalesce("ts", "_types").alias("ts"), F.when(F.col("ts").isNotNull(), "ending").otherwise("type").alias("source"))
    every = f.filter("source IS NOT NULL").unionByName(rest)
    total = F.aggregate("ts", F.lit(0.0), lambda a, t: a + t["w"])
    return every.select("form", F.explode("ts").alias("t"), "source", total.alias("total")).select("form", "t.tag", (F.col("t.w") / F.col("total")).alias("p"), "source")


def heuristic_lattice(forms: DataFrame, lexicon: DataFrame, types: DataFrame, shortest: int = 2, longest: int = 6) -> DataFrame:
    """form, tag, p, source: smoothed shares (n + 0.1) / (total + 0.1 * tags) of a form's own entries and,
    weighted by their counts, of its lower case; for unknown forms those of the longest known
    suffix of 2 to 6 letters, else those of all tags. They sum to 1."""
    shares = lambda ts, total: F.transform(ts, lambda t: F.struct(t["tag"].alias("tag"), ((t["w"] + 0.1) / (total + 0.1 * F.col("_k"))).alias("w")))
    cells = _cells(lexicon)
    tags = lexicon.groupBy("tag").agg(F.sum("n").cast("double").alias("w"))
    shown = tags.agg(F.collect_list(F.struct("tag", "w")).alias("_all"), F.sum("w").alias("_total"), F.count(F.lit(1)).alias("_k"))
    low = cells.select(F.col("form").alias("_l"), F.col("ts").alias("_ts"), F.col("freq").alias("_freq"))
    f = forms.join(cells, "form", "left").join(low, (F.lower("form") == F.col("_l")) & (F.lower("form") != F.col("form")), "left").crossJoin(F.broadcast(shown))
    part = F.coalesce(F.col("_freq") / (F.col("freq") + F.col("_freq")), F.lit(1.0))
    lower = F.transform(shares(F.col("_ts"), F.col("_freq")), lambda t: F.struct(t["tag"].alias("tag"), (t["w"] * part).alias("w")))
    none = F.array().cast("array<struct<tag:string,w:double>>")
    f = f.select("form", F.concat(F.coalesce(shares(F.col("ts"), F.col("freq")), none), F.coalesce(lower, none)).alias("ts"))
    f = stored(f, "lattice")
    rest = f.filter(F.size("ts") == 0).select("form")
    cut = lambda c: F.explode(F.transform(F.filter(F.sequence(F.lit(longest), F.lit(shortest), F.lit(-1)), lambda k: k <= F.char_length(c)), lambda k: F.right(F.lower(c), k)))
    ends = lexicon.select("tag", "n", cut("form").alias("ending")).groupBy("ending", "tag").agg(F.sum("n").cast("double").alias("w"))
    ends = ends.groupBy("ending").agg(F.collect_list(F.struct("tag", "w")).alias("ts"), F.sum("w").alias("total"))
    hit = rest.select("form", cut("form").alias("ending")).join(ends, "ending").groupBy("form").agg(F.max_by(F.struct("ts", "total"), F.char_length("ending")).alias("h"))
    rest = rest.join(hit, "form", "left").crossJoin(F.broadcast(shown))
    rest = rest.select("form", F.coalesce(shares(F.col("h.ts"), F.col("h.total")), shares(F.col("_all"), F.col("_total"))).alias("ts"), F.when(F.col("h").isNotNull(), "suffix").otherwise("type").alias("source"))
    every = f.filter(F.size("ts") > 0).withColumn("source", F.lit("lexicon")).unionByName(rest)
    flat = every.select("form", "source", F.explode("ts").alias("t")).groupBy("form", "source", "t.tag").agg(F.sum("t.w").alias("w"))
    return flat.select("form", "tag", (F.col("w") / F.sum("w").over(Window.partitionBy("form"))).alias("p"), "source")


def xpos_to_combo(tokens: DataFrame, mapping: DataFrame) -> DataFrame:
    """xpos, upos, feats: the most frequent pair of each xpos: exactly, else whatever
    its case, else without trailing digits and punctuation."""
    top = lambda key: mapping.groupBy(key.alias("k")).agg(F.max_by(F.struct("tag", "feats"), F.struct("n", "tag", "feats")).alias("c"))
    x = F.col("xpos")
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\d\p{Punct}]+$", "")
    t = tokens.select("xpos").distinct()
    for i, key in enumerate((x, F.lower(x), bare(x))):
        m = top(key).withColumnsRenamed({"k": f"_k{i}", "c": f"_c{i}"})
        t = t.join(m, key == F.col(f"_k{i}"), "left")
    best = F.coalesce("_c0", "_c1", "_c2")
    return t.select("xpos", best["tag"].alias("upos"), best["feats"].alias("feats"))


def combo_to_xpos(combos: DataFrame, mapping: DataFrame) -> DataFrame:
    """tag, feats, guess: the most frequent xpos of the pair; else of those with the
    same tag whose features contain these."""
    exact = mapping.groupBy("tag", "feats").agg(F.max_by("xpos", F.struct("n", "xpos")).alias("e"))
    wide = mapping.select("tag", F.col("feats").alias("mf"), "xpos", "n")
    c = combos.select("tag", "feats").distinct()
    subset = F.size(F.array_except(F.split(F.col("feats"), r"\|"), F.split(F.col("mf"), r"\|"))) == 0
    part = c.join(wide, "tag").filter(subset).groupBy("tag", "feats").agg(F.max_by("xpos", F.struct("n", "xpos")).alias("p"))
    return c.join(exact, ["tag", "feats"], "left").join(part, ["tag", "feats"], "left").select("tag", "feats", F.coalesce("e", "p").alias("guess"))


def clitic_match(forms: DataFrame, clitics: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, clitic, base: forms that end in a known clitic whose rest is a known form.
    Candidate endings are exploded and joined by equality: no nested loop."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(4), F.char_length("form") - 1))
    s = forms.filter(F.char_length("form") > 1).select("form", F.explode(sizes).alias("k"))
    s = s.select("form", F.right("form", F.col("k")).alias("clitic"), F.left("form", F.char_length("form") - F.col("k")).alias("base"))
    return s.join(clitics, "clitic").join(lexicon.select(F.col("form").alias("base")).distinct(), "base").select("form", "clitic", "base")


def split_contraction(forms: DataFrame, parts: DataFrame) -> DataFrame:
    """form, parts: those of the most frequent analysis; exact form, else lower case."""
    best = parts.groupBy("form").agg(F.max_by("parts", F.struct("n", "parts")).alias("parts"))
    low = best.select(F.col("form").alias("_l"), F.col("parts").alias("_p"))
    return forms.join(best, "form", "left").join(low, F.lower("form") == F.col("_l"), "left").select("form", F.coalesce("parts", "_p").alias("parts"))


def clitic_base_exists(bases: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Those ``form`` that are known as they are, in lower case, or without a final r."""
    known = lexicon.select(F.col("form").alias("_k")).distinct()
    keys = F.array_distinct(F.array(F.col("form"), F.lower("form"), F.regexp_replace(F.lower("form"), "r$", "")))
    return bases.select("form", F.explode(keys).alias("_k")).join(known, "_k", "left_semi").select("form").distinct()


def restore_normalized(tokens: DataFrame, originals: DataFrame) -> DataFrame:
    """tokens with ``original``: by form in the sentence; whatever its case; or without
    trailing punctuation."""
    key = ["doc_id", "sent_ord"]
    out = tokens
    bare = lambda c: F.regexp_replace(F.lower(c), r"[\p{Punct}]+$", "")
    for i, norm in enumerate((lambda c: F.col(c), lambda c: F.lower(c), bare)):
        o = originals.groupBy(*key, norm("norm").alias(f"_n{i}")).agg(F.min("original").alias(f"_o{i}"))
        out = out.withColumn(f"_n{i}", norm("form")).join(o, [*key, f"_n{i}"], "left").drop(f"_n{i}")
    return out.withColumn("original", F.coalesce("_o0", "_o1", "_o2")).drop("_o0", "_o1", "_o2")


def lemma_lookup(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """form, tag, guess: the lemma of the same tag, else the most frequent, else the lower case."""
    same = lexicon.groupBy("form", "tag").agg(F.max_by("lemma", F.struct("n", "lemma")).alias("a"))
    any_ = lexicon.groupBy("form").agg(F.max_by("lemma", F.struct("n", "lemma")).alias("b"))
    t = tokens.select("form", "tag").distinct()
    return t.join(same, ["form", "tag"], "left").join(any_, "form", "left").select("form", "tag", F.coalesce("a", "b", F.lower("form")).alias("guess"))
