"""Historical and variant spelling: the normalization cascade."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalization_only, punctuation_only
from . import lexicon as L

FREQUENT, RATIO, SHARE = 100, 5, 0.10


def explicit_reg(entries: DataFrame) -> DataFrame:
    """form, reg: dominant regularised forms that differ by more than case or a mark,
    are themselves known forms, and for frequent forms clearly outnumber them."""
    freq = L.form_frequency(entries)
    dom = L.dominant_reg(entries).select("form", "reg")
    d = dom.filter(~capitalization_only("form", "reg") & ~punctuation_only("form", "reg"))
    d = d.join(freq, "form").join(freq.select(F.col("form").alias("reg"), F.col("freq").alias("reg_freq")), "reg")
    sure = (F.col("freq") < FREQUENT) | ((F.col("reg_freq") >= RATIO * F.col("freq")) & (F.col("freq") <= SHARE * F.col("reg_freq")))
    return d.filter(sure).select("form", "reg")


def morph_variation(forms: DataFrame, suffixes: DataFrame, regs: DataFrame, entries: DataFrame) -> DataFrame:
    """form, reg: strip a learned suffix, regularise the base, add it again, if known.
    The longest suffix wins."""
    known = entries.select(F.col("form").alias("reg")).distinct()
    s = forms.select("form", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).filter(F.char_length("form") > F.col("k") + 2)
    s = s.select("form", F.right("form", F.col("k")).alias("suffix"), F.left("form", F.char_length("form") - F.col("k")).alias("base"))
    hit = s.join(suffixes.select("suffix"), "suffix").join(regs.select(F.col("form").alias("base"), F.col("reg").alias("rb")), "base")
    made = hit.select("form", "suffix", F.concat("rb", "suffix").alias("reg")).join(known, "reg", "left_semi")
    return made.groupBy("form").agg(F.max_by("reg", F.struct(F.char_length("suffix"), "suffix", "reg")).alias("reg"))


#: Supports a pattern needs, and a bound on pairs of characters, checked.
MIN_PATTERN, MAX_PATTERNS = 10, 10_000


def pattern_substitution(forms: DataFrame, patterns: DataFrame, entries: DataFrame) -> DataFrame:
    """form, reg: the learned character replacements, most frequent first, applied to the lower-case
    form one after another, each kept if what it makes is known: as a form in whatever case (whose
    own regular form, if any, is taken then) or as a regular form.

    Replacements go from the character of more UTF-8 bytes, or between two of several bytes.
    Forms that are known without a regular form of their own have none. Each step is a join over
    the forms that are left, so no lexicon is held in memory; patterns are few.
    """
    e = entries.select("form", F.nullif(F.nullif("reg", F.lit("")), F.lit("_")).alias("reg"))
    own = e.groupBy(F.lower("form").alias("_l")).agg(F.max((F.col("reg").isNotNull() & (F.lower("reg") != F.lower("form"))).cast("int")).alias("_own"))
    made = e.groupBy(F.lower("form").alias("w")).agg(F.min(F.when(F.lower("reg") != F.lower("form"), F.lower("reg"))).alias("better"))
    known = made.unionByName(e.filter("reg IS NOT NULL").select(F.lower("reg").alias("w"), F.lit(None).cast("string").alias("better")))
    known = known.groupBy("w").agg(F.min("better").alias("better"))
    wide = F.octet_length("old") > F.octet_length("new")
    wide |= (F.octet_length("old") == F.octet_length("new")) & (F.octet_length("old") > 1)
    steps = patterns.filter((F.col("n") >= MIN_PATTERN) & wide).orderBy(F.desc("n"), "old", "new").limit(MAX_PATTERNS + 1).collect()
    if len(steps) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    # A form's possible results: after each step the old word or the new one, as long as it is known.
    t = forms.join(own, F.lower("form") == F.col("_l"), "left").filter(F.coalesce("_own", F.lit(1)) == 1).select("form", F.lower("form").alias("w"))
    touched = t.filter(F.lit(False))
    if steps:
        olds = F.array(*[F.lit(r["old"]) for r in steps])
        touched = t.filter(F.arrays_overlap(F.split("w", ""), olds)).withColumn("cur", F.col("w"))
        for r in steps:
            new = F.replace(F.col("cur"), F.lit(r["old"]), F.lit(r["new"]))
            hit = known.withColumnsRenamed({"w": "_w", "better": "_b"})
            touched = touched.withColumn("_new", new).join(hit, (F.col("_new") == F.col("_w")) & (F.col("_new") != F.col("cur")), "left")
            touched = touched.withColumn("cur", F.when(F.col("_w").isNotNull(), F.coalesce("_b", "_new")).otherwise(F.col("cur"))).drop("_new", "_w", "_b")
        touched = touched.filter("cur != w").select("form", F.col("cur").alias("reg"))
        return touched
    return touched.select("form", F.col("w").alias("reg"))


def normalize_words(forms: DataFrame, entries: DataFrame, conservative: bool = True) -> DataFrame:
    """form, reg, way: explicit, else by suffix, else (unless conservative, and for
    unknown forms only) by character patterns. Forms that are regs have none."""
    regs = explicit_reg(entries)
    pairs = entries.filter("reg <> ''").select("form", "reg").distinct()
    todo = forms.join(pairs.select(F.col("reg").alias("form")).distinct(), "form", "left_anti")
    out = todo.join(regs, "form").withColumn("way", F.lit("explicit"))
    rest = todo.join(regs.select("form"), "form", "left_anti")
    morph = morph_variation(rest, L.suffix_evidence(pairs), regs, entries).withColumn("way", F.lit("suffix"))
    out = out.unionByName(morph)
    if not conservative:
        rest = rest.join(morph.select("form"), "form", "left_anti").join(entries.select("form").distinct(), "form", "left_anti")
        out = out.unionByName(pattern_substitution(rest, L.substitution_patterns(pairs), entries).withColumn("way", F.lit("pattern")))
    return out


def normalize_simple(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """form, reg: the least reg that differs from the form; exact form, else lower case."""
    by = entries.filter("reg <> '' AND reg <> form").groupBy("form").agg(F.min("reg").alias("reg"))
    low = by.select(F.col("form").alias("_l"), F.col("reg").alias("_r"))
    return forms.join(by, "form", "left").join(low, F.lower("form") == F.col("_l"), "left").select("form", F.coalesce("reg", "_r").alias("reg")).filter("reg IS NOT NULL")
