"""Queries: lexicons, lookups, normalization (groups E, F, G, H, K)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import lookup as LU
from ..operators import normalize as N
from ..storage import stored
from .corpus import GOLD_SQL, TOK_SQL, gold, read, tokens
from .q_text import CASE_SQL
from .registry import query

ENTRIES_SQL = GOLD_SQL + ", lex AS (SELECT form, lemma, xpos, tag, feats, reg, count(*) AS n FROM gold WHERE doc_id % 2 = 0 GROUP BY ALL)\n"
TEST_SQL = ENTRIES_SQL + ", frm AS (SELECT DISTINCT form FROM gold)\n"
END_SQL = ", ends AS (SELECT right(form, k) AS ending, tag, count(*) AS n FROM (SELECT form, tag, unnest(generate_series(1, least(6, length(form)))) AS k FROM lex) GROUP BY 1, 2)\n"


def train(spark, d):
    return gold(spark, d).filter("doc_id % 2 = 0")


def entries(spark, d):
    """The lexicon of the even documents; written once where a query reads it several times."""
    return L.vocab_counts(train(spark, d))


def test_forms(spark, d):
    """The forms of all tokens: lexicons are learned from the even documents, and looked up for all."""
    return tokens(spark, d).select("form").distinct()


@query("vocab_counts", GOLD_SQL + "SELECT form, lemma, xpos, tag, feats, reg, count(*) AS n FROM gold GROUP BY ALL")
def _(spark, d):
    return L.vocab_counts(gold(spark, d))


TRANS_SQL = GOLD_SQL + ", tr AS (SELECT prev, next, count(*) AS n FROM (SELECT lag(tag) OVER (PARTITION BY doc_id, sent_ord ORDER BY tok_ord) AS prev, tag AS next FROM gold) WHERE prev IS NOT NULL GROUP BY ALL)\n"


@query("transition_counts", TRANS_SQL + "SELECT * FROM tr")
def _(spark, d):
    return L.transition_counts(gold(spark, d))


@query("bigram_prev", GOLD_SQL + "SELECT tag, coalesce(p, '^') AS prev_tag, count(*) AS n FROM (SELECT tag, lag(tag) OVER (PARTITION BY doc_id, sent_ord ORDER BY tok_ord) AS p FROM gold) GROUP BY ALL")
def _(spark, d):
    return L.with_previous_tag(gold(spark, d)).groupBy("tag", F.coalesce("prev_tag", F.lit("^")).alias("prev_tag")).agg(L.n())


@query("start_counts", GOLD_SQL + "SELECT tag, count(*) AS n FROM gold WHERE tok_ord = 0 GROUP BY tag")
def _(spark, d):
    return L.start_counts(gold(spark, d))


@query("case_counts", GOLD_SQL + f"SELECT tag, {CASE_SQL} AS wcase, count(*) AS n FROM gold GROUP BY ALL")
def _(spark, d):
    return L.case_counts(gold(spark, d))


@query("mwt_parts", TOK_SQL + r"""
SELECT form, parts, count(*) AS n FROM (SELECT form, array_to_string(string_split_regex(form, '[''-]'), '+') AS parts FROM tok WHERE regexp_matches(form, '\p{L}[''-]\p{L}')) GROUP BY ALL""")
def _(spark, d):
    t = tokens(spark, d).filter(F.col("form").rlike(r"\p{L}['-]\p{L}"))
    return L.mwt_parts(t.select("form", F.array_join(F.split("form", "['-]"), "+").alias("parts")))


@query("vocab_stats", GOLD_SQL + "SELECT count(DISTINCT form) AS total_entries, count(DISTINCT (doc_id, sent_ord)) AS sentences, count(*) AS tokens FROM gold")
def _(spark, d):
    return L.vocab_stats(gold(spark, d))


@query("ending_index", ENTRIES_SQL + END_SQL + "SELECT * FROM ends")
def _(spark, d):
    return L.ending_index(entries(spark, d))


@query("type_counts", ENTRIES_SQL + "SELECT tag, count(DISTINCT form) AS n_types FROM lex GROUP BY tag")
def _(spark, d):
    return L.type_counts(entries(spark, d))


@query("form_frequency", TOK_SQL + "SELECT form, count(*) AS freq FROM tok GROUP BY form")
def _(spark, d):
    return L.form_frequency(L.vocab_counts(tokens(spark, d), ["form"]))


# Regularised spelling: form, reg with a stand-in that is plain in every second document.
VARIANTS_SQL = GOLD_SQL + ", ent AS (SELECT form, CASE WHEN doc_id % 3 = 0 THEN '' ELSE reg END AS reg, count(*) AS n FROM gold GROUP BY ALL)\n, prs AS (SELECT DISTINCT form, reg FROM ent WHERE reg <> '')\n"
DOM_SQL = ", br AS (SELECT form, reg, sum(n) AS n FROM ent GROUP BY ALL), dom AS (SELECT form, top.reg AS reg, top.n AS n FROM (SELECT form, sum(CASE WHEN reg = '' THEN n ELSE 0 END) AS plain, max(CASE WHEN reg <> '' THEN {'n': n, 'reg': reg} END) AS top, sum(n) AS total FROM br GROUP BY form) WHERE top IS NOT NULL AND (top.n > plain OR plain < 0.2 * total))\n"


def variants(spark, d):
    g = gold(spark, d).withColumn("reg", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("reg")))
    return L.vocab_counts(g, ["form", "reg"])


def pairs(spark, d):
    return variants(spark, d).filter("reg <> ''").select("form", "reg").distinct()


@query("dominant_reg", VARIANTS_SQL + DOM_SQL + "SELECT form, reg, CAST(n AS BIGINT) AS n FROM dom")
def _(spark, d):
    return L.dominant_reg(variants(spark, d))


SUF_SQL = ", suf AS (SELECT suffix, count(*) AS n FROM (SELECT right(form, k) AS suffix, form, reg, k FROM (SELECT form, reg, unnest(generate_series(1, 4)) AS k FROM prs) WHERE length(form) > k AND length(reg) > k AND right(form, k) = right(reg, k) AND left(form, length(form) - k) <> left(reg, length(reg) - k)) GROUP BY suffix HAVING count(*) >= 5)\n"
PAT_SQL = ", pat AS (SELECT old, new, count(*) AS n FROM (SELECT substr(form, i, 1) AS old, substr(reg, i, 1) AS new FROM (SELECT form, reg, unnest(generate_series(1, length(form))) AS i FROM prs WHERE length(form) = length(reg))) WHERE old <> new GROUP BY ALL HAVING count(*) >= 10)\n"


@query("suffix_evidence", VARIANTS_SQL + SUF_SQL + "SELECT * FROM suf")
def _(spark, d):
    return L.suffix_evidence(pairs(spark, d))


@query("substitution_patterns", VARIANTS_SQL + PAT_SQL + "SELECT * FROM pat")
def _(spark, d):
    return L.substitution_patterns(pairs(spark, d))


REGS_SQL = VARIANTS_SQL + DOM_SQL + r""", fq AS (SELECT form, sum(n) AS freq FROM ent GROUP BY form),
regs AS (SELECT dom.form, dom.reg FROM dom JOIN fq a ON dom.form = a.form JOIN fq b ON dom.reg = b.form
 WHERE lower(dom.form) <> lower(dom.reg) AND NOT (regexp_matches(dom.form, '^[\p{Po}\p{Pi}\p{Pf}]$') AND regexp_matches(dom.reg, '^[\p{Po}\p{Pi}\p{Pf}]$'))
 AND (a.freq < 100 OR (b.freq >= 5 * a.freq AND a.freq <= 0.10 * b.freq)))
"""
MORPH_SQL = SUF_SQL + """, al AS (SELECT DISTINCT form FROM ent), mv AS (
 SELECT form, max({'l': length(suffix), 's': suffix, 'r': rb || suffix}).r AS reg FROM (
  SELECT f.form, right(f.form, k) AS suffix, left(f.form, length(f.form) - k) AS base FROM (SELECT form, unnest(generate_series(1, 4)) AS k FROM todo) f WHERE length(f.form) > k + 2) x
 JOIN suf USING (suffix) JOIN (SELECT form AS base, reg AS rb FROM regs) r USING (base) WHERE rb || suffix IN (SELECT form FROM al) GROUP BY form)
"""


@query("morph_variation", REGS_SQL + ", todo AS (SELECT DISTINCT form FROM ent)\n" + MORPH_SQL + "SELECT * FROM mv")
def _(spark, d):
    e = variants(spark, d)
    return N.morph_variation(e.select("form").distinct(), L.suffix_evidence(pairs(spark, d)), N.explicit_reg(e), e)


_STEPS_SQL = VARIANTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + PAT_SQL + """, kn AS (SELECT form, CASE WHEN doc_id % 3 = 0 THEN '' ELSE reg END AS reg FROM gold WHERE doc_id % 2 = 0 GROUP BY ALL),
own AS (SELECT lower(form) AS l, max(CASE WHEN reg <> '' AND lower(reg) <> lower(form) THEN 1 ELSE 0 END) AS own FROM kn GROUP BY 1),
wk AS (SELECT w, min(better) AS better FROM (SELECT lower(form) AS w, min(CASE WHEN reg <> '' AND lower(reg) <> lower(form) THEN lower(reg) END) AS better FROM kn GROUP BY 1 UNION ALL SELECT lower(reg), NULL FROM kn WHERE reg <> '') GROUP BY w),
pp AS (SELECT old, new, row_number() OVER (ORDER BY n DESC, old, new) AS i FROM pat WHERE strlen(old) > strlen(new) OR (strlen(old) = strlen(new) AND strlen(old) > 1)),
st AS (SELECT f.form, lower(f.form) AS cur, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT form FROM gold) f LEFT JOIN own ON lower(f.form) = own.l WHERE coalesce(own, 1) = 1
 UNION ALL SELECT st.form, CASE WHEN wk.w IS NOT NULL THEN coalesce(wk.better, replace(cur, old, new)) ELSE cur END, st.i + 1 FROM st JOIN pp ON pp.i = st.i + 1 LEFT JOIN wk ON wk.w = replace(cur, old, new) AND replace(cur, old, new) <> cur)
SELECT form, cur AS reg FROM st WHERE i = (SELECT count(*) FROM pp) AND cur <> lower(form)"""


@query("pattern_substitution", _STEPS_SQL)
def _(spark, d):
    """All forms against the lexicon of the even documents; patterns are those of all."""
    g = gold(spark, d).withColumn("reg", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("reg")))
    known = stored(g.filter("doc_id % 2 = 0").select("form", "reg").distinct(), "known")
    return N.pattern_substitution(test_forms(spark, d), L.substitution_patterns(pairs(spark, d)), known)


@query("normalize_word", REGS_SQL + ", td AS (SELECT DISTINCT form FROM ent WHERE form NOT IN (SELECT reg FROM prs)), todo AS (SELECT form FROM td WHERE form NOT IN (SELECT form FROM regs))\n" + MORPH_SQL + """
SELECT regs.form, reg, 'explicit' AS way FROM regs JOIN td USING (form) UNION ALL SELECT form, reg, 'suffix' FROM mv""")
def _(spark, d):
    e = variants(spark, d)
    return N.normalize_words(e.select("form").distinct(), e)


@query("normalize_simple", VARIANTS_SQL + """, bs AS (SELECT form, min(reg) AS reg FROM prs WHERE reg <> form GROUP BY form)
SELECT f.form, coalesce(a.reg, b.reg) AS reg FROM (SELECT DISTINCT form FROM ent) f LEFT JOIN bs a ON f.form = a.form LEFT JOIN bs b ON lower(f.form) = b.form WHERE coalesce(a.reg, b.reg) IS NOT NULL""")
def _(spark, d):
    e = variants(spark, d)
    return N.normalize_simple(e.select("form").distinct(), e)


@query("merge_lexicons", GOLD_SQL + "SELECT form, tag, count(*) AS n FROM gold GROUP BY ALL")
def _(spark, d):
    g = gold(spark, d)
    half = lambda k: L.vocab_counts(g.filter(f"doc_id % 2 = {k}"), ["form", "tag"])
    return L.merge_lexicons(half(0), half(1))


@query("load_extra_lexicon", GOLD_SQL + "SELECT form, tag, count(*) AS n FROM gold GROUP BY ALL")
def _(spark, d):
    g = gold(spark, d)
    part = lambda sign: L.vocab_counts(g.filter(f"doc_id % 3 {sign} 0"), ["form", "tag"])
    return L.merge_lexicons(part("<>"), part("="))


MAP_SQL = ENTRIES_SQL + ", mp AS (SELECT xpos, tag, feats, CAST(sum(greatest(n, 1)) AS BIGINT) AS n FROM lex GROUP BY ALL)\n"


@query("tag_mapping_counts", MAP_SQL + "SELECT * FROM mp")
def _(spark, d):
    return L.tag_mapping_counts(entries(spark, d))


@query("xpos_histogram", GOLD_SQL + "SELECT xpos, count(*) AS n FROM gold GROUP BY xpos")
def _(spark, d):
    return L.xpos_histogram(gold(spark, d))


@query("most_common", ENTRIES_SQL + "SELECT form, max({'n': n, 't': tag}).t AS tag, max(n) AS n FROM (SELECT form, tag, CAST(sum(n) AS BIGINT) AS n FROM lex GROUP BY ALL) GROUP BY form")
def _(spark, d):
    return L.most_common(entries(spark, d).groupBy("form", "tag").agg(F.sum("n").alias("n")), "form", "tag")


@query("emission_prob", ENTRIES_SQL + ", b AS (SELECT form, tag, sum(n) AS n FROM lex GROUP BY ALL), t AS (SELECT form, sum(n) AS total, count(*) AS tags FROM b GROUP BY form) SELECT form, tag, CAST(round((n + 0.1) / (total + 0.1 * tags), 6) AS DOUBLE) AS p FROM b JOIN t USING (form)")
def _(spark, d):
    return L.emission_probabilities(entries(spark, d)).withColumn("p", F.round("p", 6))


@query("transition_prob", TRANS_SQL + "SELECT prev, next, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY prev), 6) AS p FROM tr")
def _(spark, d):
    return L.transition_probabilities(L.transition_counts(gold(spark, d))).withColumn("p", F.round("p", 6))


LEX2_SQL = TEST_SQL + ", l2 AS (SELECT form, tag, CAST(sum(n) AS BIGINT) AS n FROM lex GROUP BY ALL)\n"
LOWER_SQL = """, rest AS (SELECT form FROM frm WHERE form NOT IN (SELECT form FROM lex)),
sp AS (SELECT form, lower(form) AS low, sum(n) AS freq FROM l2 GROUP BY form), bst AS (SELECT low, form AS entry FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY freq DESC, form) AS r FROM sp) WHERE r = 1),
lw AS (SELECT rest.form, l2.tag, greatest(l2.n, 1) * CAST(0.1 AS DOUBLE) AS weight FROM rest JOIN bst ON lower(rest.form) = bst.low JOIN l2 ON l2.form = bst.entry)
"""


@query("lexicon_exact", LEX2_SQL + "SELECT form, tag, CAST(greatest(n, 1) AS DOUBLE) AS weight FROM frm JOIN l2 USING (form)")
def _(spark, d):
    e = L.vocab_counts(train(spark, d), ["form", "tag"])
    return LU.lexicon_exact(test_forms(spark, d), e)


@query("lexicon_lower", LEX2_SQL + LOWER_SQL + "SELECT form, tag, round(weight, 6) AS weight FROM lw")
def _(spark, d):
    e = stored(L.vocab_counts(train(spark, d), ["form", "tag"]), "lexicon")
    return LU.lexicon_lower(test_forms(spark, d), e).withColumn("weight", F.round("weight", 6))


ENDL_SQL = END_SQL + """, sx2 AS (SELECT form, right(form, k) AS ending FROM (SELECT form, unnest(generate_series(1, least(6, length(form)))) AS k FROM {src})),
hit AS (SELECT form, ending, row_number() OVER (PARTITION BY form ORDER BY length(ending) DESC) AS k FROM sx2 WHERE ending IN (SELECT ending FROM ends)),
el AS (SELECT form, ending, tag, n * pow(CAST(2 AS DOUBLE), -k) AS weight FROM hit JOIN ends USING (ending) WHERE k <= 3)
"""


@query("ending_lookup", TEST_SQL + ENDL_SQL.replace("{src}", "frm") + "SELECT * FROM el")
def _(spark, d):
    return LU.ending_lookup(test_forms(spark, d), L.ending_index(entries(spark, d)))


@query("candidate_lattice", LEX2_SQL + LOWER_SQL + ", r2 AS (SELECT form FROM rest WHERE form NOT IN (SELECT form FROM lw))\n" + ENDL_SQL.replace("{src}", "r2") + """
, r3 AS (SELECT form FROM r2 WHERE form NOT IN (SELECT form FROM el)), ty AS (SELECT tag, count(DISTINCT form) AS w FROM lex GROUP BY tag),
al AS (SELECT form, tag, CAST(greatest(n, 1) AS DOUBLE) AS w, 'lexicon' AS source FROM frm JOIN l2 USING (form) UNION ALL SELECT form, tag, weight, 'lower' FROM lw
 UNION ALL SELECT form, tag, sum(weight), 'ending' FROM el GROUP BY ALL UNION ALL SELECT form, tag, w, 'type' FROM r3, ty)
SELECT form, tag, source, round(w / sum(w) OVER (PARTITION BY form), 6) AS p FROM al""")
def _(spark, d):
    e = stored(entries(spark, d), "lexicon")
    return LU.candidate_lattice(test_forms(spark, d), e, L.ending_index(e), L.type_counts(e)).withColumn("p", F.round("p", 6))


@query("tagger_stats", LEX2_SQL + "SELECT count(*) AS word_count, count(*) FILTER (WHERE form NOT IN (SELECT form FROM lex)) AS oov_count FROM gold")
def _(spark, d):
    known = entries(spark, d).select("form", F.lit(True).alias("known")).distinct()
    forms = L.vocab_counts(tokens(spark, d), ["form"])
    return forms.join(known, "form", "left").agg(F.sum("n").alias("word_count"), F.sum(F.when(F.col("known"), 0).otherwise(F.col("n"))).alias("oov_count"))


@query("xpos_to_combo", MAP_SQL + r""", q AS (SELECT DISTINCT concat(xpos, CASE WHEN doc_id % 3 = 0 THEN '7' ELSE '' END) AS xpos FROM gold),
e AS (SELECT xpos AS k, max({'n': n, 't': tag, 'f': feats}) AS c FROM mp GROUP BY 1), l AS (SELECT lower(xpos) AS k, max({'n': n, 't': tag, 'f': feats}) AS c FROM mp GROUP BY 1),
b AS (SELECT regexp_replace(lower(xpos), '[\d[:punct:]]+$', '') AS k, max({'n': n, 't': tag, 'f': feats}) AS c FROM mp GROUP BY 1)
SELECT xpos, coalesce(e.c, l.c, b.c).t AS upos, coalesce(e.c, l.c, b.c).f AS feats FROM q LEFT JOIN e ON q.xpos = e.k LEFT JOIN l ON lower(q.xpos) = l.k LEFT JOIN b ON regexp_replace(lower(q.xpos), '[\d[:punct:]]+$', '') = b.k""")
def _(spark, d):
    q = gold(spark, d).select(F.concat("xpos", F.when(F.col("doc_id") % 3 == 0, "7").otherwise("")).alias("xpos"))
    return LU.xpos_to_combo(q, L.tag_mapping_counts(entries(spark, d)))


COMBO_SQL = MAP_SQL + """, q AS (SELECT DISTINCT tag, CASE WHEN doc_id % 3 = 0 THEN split_part(feats, '|', 1) ELSE feats END AS feats FROM gold),
e AS (SELECT tag, feats, max({'n': n, 'x': xpos}).x AS e FROM mp GROUP BY ALL),
p AS (SELECT q.tag, q.feats, max({'n': n, 'x': xpos}).x AS p FROM q JOIN mp ON q.tag = mp.tag AND list_has_all(string_split(mp.feats, '|'), string_split(q.feats, '|')) GROUP BY ALL)
"""


def combos(spark, d):
    return gold(spark, d).select("tag", F.when(F.col("doc_id") % 3 == 0, F.split_part("feats", F.lit("|"), F.lit(1))).otherwise(F.col("feats")).alias("feats"))


@query("combo_to_xpos", COMBO_SQL + "SELECT q.tag, q.feats, coalesce(e, p) AS guess FROM q LEFT JOIN e USING (tag, feats) LEFT JOIN p USING (tag, feats)")
def _(spark, d):
    return LU.combo_to_xpos(combos(spark, d), L.tag_mapping_counts(entries(spark, d)))


@query("partial_feat_xpos", COMBO_SQL + "SELECT tag, feats, p AS guess FROM p WHERE (tag, feats) NOT IN (SELECT (tag, feats) FROM e)")
def _(spark, d):
    m = L.tag_mapping_counts(entries(spark, d))
    return LU.combo_to_xpos(combos(spark, d), m).join(m.select("tag", "feats").distinct(), ["tag", "feats"], "left_anti").filter("guess IS NOT NULL")


@query("enrich_tags", COMBO_SQL + ", g AS (SELECT coalesce(e, p) AS guess, q.tag, q.feats FROM q LEFT JOIN e USING (tag, feats) LEFT JOIN p USING (tag, feats)) SELECT coalesce(guess, '_') AS xpos, count(*) AS n FROM (SELECT tag, CASE WHEN doc_id % 3 = 0 THEN split_part(feats, '|', 1) ELSE feats END AS feats FROM gold) t JOIN g USING (tag, feats) GROUP BY 1")
def _(spark, d):
    c = combos(spark, d)
    g = LU.combo_to_xpos(c, L.tag_mapping_counts(entries(spark, d)))
    return c.join(g, ["tag", "feats"]).groupBy(F.coalesce("guess", F.lit("_")).alias("xpos")).agg(L.n())


@query("clitic_match", TEST_SQL + """, c AS (SELECT form, right(form, k) AS clitic, left(form, length(form) - k) AS base FROM (SELECT form, unnest(generate_series(1, least(4, length(form) - 1))) AS k FROM frm WHERE length(form) > 1))
SELECT form, clitic, base FROM c WHERE clitic IN ('le', 'the', 'ing', 'la', 's') AND base IN (SELECT form FROM lex)""")
def _(spark, d):
    clitics = spark.createDataFrame([(c,) for c in ("le", "the", "ing", "la", "s")], "clitic string")
    return LU.clitic_match(test_forms(spark, d), clitics, entries(spark, d))


PARTS_SQL = r", prt AS (SELECT form, parts, count(*) AS n FROM (SELECT form, left(form, 2) || '+' || substr(form, 3) AS parts FROM gold WHERE doc_id % 2 = 0 AND length(form) > 8 UNION ALL SELECT form, left(form, 3) || '+' || substr(form, 4) FROM gold WHERE doc_id % 4 = 0 AND length(form) > 8) GROUP BY ALL)"


@query("split_contraction", TEST_SQL + PARTS_SQL + ", b AS (SELECT form, max({'n': n, 'p': parts}).p AS parts FROM prt GROUP BY form) SELECT f.form, coalesce(b.parts, c.parts) AS parts FROM frm f LEFT JOIN b ON f.form = b.form LEFT JOIN b c ON lower(f.form) = c.form")
def _(spark, d):
    long = gold(spark, d).filter(F.char_length("form") > 8)
    cut = lambda k: F.concat(F.left("form", F.lit(k)), F.lit("+"), F.substring("form", k + 1, 1000))
    a = long.filter("doc_id % 2 = 0").select("form", cut(2).alias("parts"))
    b = long.filter("doc_id % 4 = 0").select("form", cut(3).alias("parts"))
    return LU.split_contraction(test_forms(spark, d), L.mwt_parts(a.union(b)))


@query("clitic_base_exists", TEST_SQL + "SELECT DISTINCT form FROM frm WHERE form IN (SELECT form FROM lex) OR lower(form) IN (SELECT form FROM lex) OR regexp_replace(lower(form), 'r$', '') IN (SELECT form FROM lex)")
def _(spark, d):
    return LU.clitic_base_exists(test_forms(spark, d), entries(spark, d))


@query("restore_normalized", GOLD_SQL + "SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(tok_ord AS BIGINT) AS tok_ord, coalesce(min(form) OVER (PARTITION BY doc_id, sent_ord, f), form) AS original FROM (SELECT *, translate(form, 'àâäáéèêëîïíôöóúùûüñç', 'aaaaeeeeiiiooouuuunc') AS f FROM gold WHERE reg <> '')")
def _(spark, d):
    g = gold(spark, d).filter("reg <> ''")
    originals = g.select("doc_id", "sent_ord", F.col("reg").alias("norm"), F.col("form").alias("original"))
    t = g.select("doc_id", "sent_ord", "tok_ord", F.col("reg").alias("form"))
    return LU.restore_normalized(t, originals).select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), F.col("tok_ord").cast("bigint").alias("tok_ord"), "original")


@query("lemma_lookup", ENTRIES_SQL + ", q AS (SELECT DISTINCT form, tag FROM gold), a AS (SELECT form, tag, max({'n': n, 'l': lemma}).l AS a FROM lex GROUP BY ALL), b AS (SELECT form, max({'n': n, 'l': lemma}).l AS b FROM lex GROUP BY form) SELECT q.form, q.tag, coalesce(a, b, lower(q.form)) AS guess FROM q LEFT JOIN a USING (form, tag) LEFT JOIN b ON q.form = b.form")
def _(spark, d):
    return LU.lemma_lookup(gold(spark, d), entries(spark, d))


@query("train_model", TRANS_SQL + "SELECT 'lexicon' AS name, count(*) AS n_rows FROM (SELECT DISTINCT form, lemma, xpos, tag, feats, reg FROM gold) UNION ALL SELECT 'transitions', count(*) FROM tr UNION ALL SELECT 'starts', count(DISTINCT tag) FROM gold WHERE tok_ord = 0 UNION ALL SELECT 'types', count(DISTINCT tag) FROM gold")
def _(spark, d):
    tables = L.train_model(gold(spark, d))
    out = [tables[k].agg(L.n("n_rows")).select(F.lit(k).alias("name"), "n_rows") for k in ("lexicon", "transitions", "starts", "types")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("top_forms", TOK_SQL + ", c AS (SELECT lang, form, count(*) AS n FROM tok GROUP BY ALL) SELECT lang, form, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, form) AS r FROM c) WHERE r <= 3")
def _(spark, d):
    counts = L.vocab_counts(tokens(spark, d), ["lang", "form"])
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "form")
    return counts.withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query("read_unimorph_tsv", "SELECT lower(regexp_extract(p_name, '^[^ ]+')) AS lemma, p_name AS form, 'N;' || CASE WHEN p_size % 2 = 0 THEN 'SG' ELSE 'PL' END AS codes, 'NOUN' AS upos, CASE WHEN p_size % 2 = 0 THEN 'Number=Sing' ELSE 'Number=Plur' END AS feats FROM part")
def _(spark, d):
    from ..sources.lexicon_tsv import parse_unimorph_lines

    p = read(spark, d, "part")
    line = F.concat_ws("\t", F.regexp_extract("p_name", "^[^ ]+", 0), "p_name", F.concat(F.lit("N;"), F.when(F.col("p_size") % 2 == 0, "SG").otherwise("PL")))
    return parse_unimorph_lines(p.select(line.alias("value")))
