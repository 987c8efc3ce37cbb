"""Queries: alignment, metrics, spans, splits, catalogs (groups C, E, F, G, H, I)."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import feats as FE
from ..operators import alignment as A
from ..operators import catalog as C
from ..operators import lexicon as L
from ..operators import metrics as M
from ..operators import spans as S
from ..operators import splits as SP
from .corpus import GOLD_SQL, SENT_SQL, TOK_SQL, explode_sentences, gold, read, tokens
from .q_lexicon import ENTRIES_SQL, entries
from .registry import query

BEST_SQL = ENTRIES_SQL + """, bt AS (SELECT form, max({'n': n, 't': tag, 'l': lemma, 'f': feats, 'x': xpos}) AS b, CAST(sum(n) AS BIGINT) AS freq FROM lex GROUP BY form),
pairs AS (SELECT g.doc_id, g.lang, g.sent_ord, g.tok_ord, g.form AS g_form, g.tag AS g_upos, g.xpos AS g_xpos, g.lemma AS g_lemma, g.feats AS g_feats, g.reg AS g_reg, g.head AS g_head, g.deprel AS g_deprel,
 CASE WHEN g.tok_ord % 7 <> 6 THEN g.form END AS p_form, CASE WHEN g.tok_ord % 7 <> 6 THEN b.t END AS p_upos, CASE WHEN g.tok_ord % 7 <> 6 THEN b.x END AS p_xpos,
 CASE WHEN g.tok_ord % 7 <> 6 THEN b.l END AS p_lemma, CASE WHEN g.tok_ord % 7 <> 6 THEN CASE WHEN g.tok_ord % 5 = 0 THEN split_part(g.feats, '|', 1) ELSE g.feats END END AS p_feats,
 CASE WHEN g.tok_ord % 7 <> 6 THEN g.reg END AS p_reg, CASE WHEN g.tok_ord % 7 <> 6 THEN CASE WHEN g.tok_ord % 3 = 2 OR g.head % 7 = 0 THEN 0 ELSE g.head - g.head // 7 END END AS p_head, g.tok_ord + 1 AS g_id, CASE WHEN g.tok_ord % 7 <> 6 THEN g.tok_ord + 1 - (g.tok_ord + 1) // 7 END AS p_id,
 CASE WHEN g.tok_ord % 7 <> 6 THEN CASE WHEN length(g.form) < 5 AND g.tok_ord > 0 THEN 'case' ELSE g.deprel END END AS p_deprel, freq
 FROM gold g LEFT JOIN bt ON g.form = bt.form)
"""


def pairs(spark, d):
    """All documents against what a most-frequent-tag lexicon of the even ones says;
    every seventh token has no partner."""
    best = entries(spark, d).groupBy("form").agg(F.max(F.struct("n", "tag", "lemma", "feats", "xpos")).alias("b"), F.sum("n").alias("freq"))
    g = gold(spark, d).join(best, "form", "left")
    t = F.col("tok_ord")
    there = lambda c: F.when(t % 7 != 6, c)
    names = {"form": "form", "upos": "tag", "xpos": "xpos", "lemma": "lemma", "feats": "feats", "reg": "reg", "head": "head", "deprel": "deprel"}
    predicted = {
        "form": F.col("form"), "upos": F.col("b.tag"), "xpos": F.col("b.xpos"), "lemma": F.col("b.lemma"),
        "feats": F.when(t % 5 == 0, F.split_part("feats", F.lit("|"), F.lit(1))).otherwise(F.col("feats")), "reg": F.col("reg"),
        # The predicted sentence counts without the tokens it lacks.
        "head": F.when((t % 3 == 2) | (F.col("head") % 7 == 0), 0).otherwise(F.expr("head - head div 7").cast("int")),
        "deprel": F.when((F.char_length("form") < 5) & (t > 0), "case").otherwise(F.col("deprel")),
    }
    ids = [(t + 1).alias("g_id"), there(F.expr("tok_ord + 1 - (tok_ord + 1) div 7").cast("int")).alias("p_id")]
    return g.select("doc_id", "lang", "sent_ord", "tok_ord", "freq", *ids, *[F.col(c).alias(f"g_{k}") for k, c in names.items()], *[there(c).alias(f"p_{k}") for k, c in predicted.items()])


ACC_SQL = BEST_SQL + """, s AS (SELECT *, string_split(g_feats, '|') AS gf, string_split(p_feats, '|') AS pf FROM pairs)
"""


def _metric(name, of, right):
    return f"SELECT {{lang}}'{name}' AS metric, count(*) FILTER (WHERE ({of}) AND ({right})) AS correct, count(*) FILTER (WHERE {of}) AS total FROM s {{by}}"


_F = "coalesce(nullif(g_feats, '_'), '') = coalesce(nullif(p_feats, '_'), '') AND p_form IS NOT NULL"
_ALL = " UNION ALL ".join(
    [_metric("tokenization", "p_form IS NOT NULL", "g_form = p_form")]
    + [_metric(x, f"g_{x} NOT IN ('', '_')", f"g_{x} = p_{x}") for x in ("upos", "xpos", "lemma", "reg")]
    + [
        _metric("feats", "true", _F),
        _metric("feats_partial", "g_feats <> '_' OR p_feats <> '_'", "p_form IS NOT NULL AND CASE WHEN p_feats = '_' THEN g_feats = '_' ELSE g_feats <> '_' AND list_has_all(gf, pf) END"),
        _metric("upos+feats", "g_upos <> '' OR g_feats <> '_'", f"g_upos = p_upos AND {_F}"),
    ]
)


@query("accuracy_metrics", ACC_SQL + _ALL.replace("{lang}", "lang, ").replace("{by}", "GROUP BY lang"))
def _(spark, d):
    return M.accuracy_metrics(pairs(spark, d), ("lang",))


@query("attachment_scores", BEST_SQL + """, h AS (SELECT g.lang, g.g_deprel, g.p_deprel, (g.g_head = 0 AND g.p_head = 0) OR (g.g_head > 0 AND g.p_head > 0 AND coalesce(x.p_id = g.p_head, false)) AS head
 FROM pairs g LEFT JOIN pairs x ON g.doc_id = x.doc_id AND g.sent_ord = x.sent_ord AND g.g_head = x.g_id WHERE g.p_deprel IS NOT NULL)
SELECT lang, round(avg(CASE WHEN head THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS uas, round(avg(CASE WHEN head AND g_deprel = p_deprel THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS las, count(*) AS n FROM h GROUP BY lang""")
def _(spark, d):
    return M.attachment_scores(pairs(spark, d), ("lang",)).withColumns({c: F.round(c, 6) for c in ("uas", "las")})


@query("split_scores", TOK_SQL + r""", w AS (SELECT form, CASE WHEN regexp_matches(form, '[''-]') THEN string_split_regex(form, '[''-]') END AS g, CASE WHEN contains(form, '-') OR length(form) > 12 THEN string_split(form, '-') END AS p FROM tok)
SELECT round(count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) / nullif(CAST(count(*) FILTER (WHERE g IS NOT NULL) AS DOUBLE), 0), 6) AS recall, round(count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) / nullif(CAST(count(*) FILTER (WHERE p IS NOT NULL) AS DOUBLE), 0), 6) AS "precision",
 round(count(*) FILTER (WHERE g = p) / nullif(CAST(count(*) FILTER (WHERE g IS NOT NULL AND p IS NOT NULL) AS DOUBLE), 0), 6) AS form_accuracy FROM w""")
def _(spark, d):
    t = tokens(spark, d)
    g = F.when(F.col("form").rlike("['-]"), F.split("form", "['-]", -1))
    p = F.when(F.col("form").contains("-") | (F.char_length("form") > 12), F.split("form", "-", -1))
    return M.split_scores(t.select(g.alias("g_parts"), p.alias("p_parts"))).withColumns({c: F.round(c, 6) for c in ("recall", "precision", "form_accuracy")})


@query("candidate_accuracy", BEST_SQL + "SELECT round(avg(CASE WHEN g_upos = p_upos THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS pos_accuracy, round(avg(CASE WHEN g_lemma = p_lemma THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS lemma_accuracy FROM pairs")
def _(spark, d):
    return M.candidate_accuracy(pairs(spark, d)).withColumns({c: F.round(c, 6) for c in ("pos_accuracy", "lemma_accuracy")})


_FREQ = "CASE WHEN coalesce(freq, 0) = 0 THEN '0' WHEN freq <= 4 THEN '1-4' WHEN freq <= 19 THEN '5-19' WHEN freq <= 99 THEN '20-99' ELSE '100+' END"
_LEN = "CASE WHEN length(g_form) <= 3 THEN '1-3' WHEN length(g_form) <= 6 THEN '4-6' WHEN length(g_form) <= 10 THEN '7-10' ELSE '11+' END"
_POS = "CASE WHEN tok_ord < 20 THEN 'start' WHEN tok_ord < 40 THEN 'early' WHEN tok_ord < 60 THEN 'middle' ELSE 'late' END"
_OOV = "CASE WHEN coalesce(freq, 0) = 0 THEN 'oov' ELSE 'known' END"
_OK = "count(*) FILTER (WHERE g_upos = p_upos) AS correct, count(*) AS total FROM pairs GROUP BY ALL"


@query("error_breakdown", BEST_SQL + " UNION ALL ".join(f"SELECT '{n}' AS dimension, {b} AS bucket, {_OK}" for n, b in (("oov", _OOV), ("length", _LEN), ("frequency", _FREQ), ("position", _POS), ("oov*length", f"{_OOV} || '/' || {_LEN}"))))
def _(spark, d):
    return M.error_breakdown(pairs(spark, d))


@query("lexicon_accuracy", BEST_SQL + f"SELECT {_FREQ} AS bucket, count(*) AS n, round(avg(CASE WHEN g_upos = p_upos THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy FROM pairs GROUP BY 1")
def _(spark, d):
    ok = F.avg(F.when(F.col("g_upos") == F.col("p_upos"), F.lit(1.0)).otherwise(F.lit(0.0)))
    return pairs(spark, d).groupBy(M.BUCKETS["frequency"]().alias("bucket")).agg(L.n(), F.round(ok, 6).alias("accuracy"))


@query("feats_partial_match", ACC_SQL + "SELECT CASE WHEN p_feats = '_' THEN g_feats = '_' ELSE g_feats <> '_' AND list_has_all(gf, pf) END AS ok, count(*) AS n FROM s WHERE p_form IS NOT NULL GROUP BY 1")
def _(spark, d):
    return pairs(spark, d).filter("p_form IS NOT NULL").groupBy(FE.feats_partial_match("g_feats", "p_feats").alias("ok")).agg(L.n())


@query("feats_match_script", ACC_SQL + "SELECT g_feats = '_' OR (p_feats <> '_' AND list_has_all(pf, gf)) AS ok, count(*) AS n FROM s WHERE p_form IS NOT NULL GROUP BY 1")
def _(spark, d):
    return pairs(spark, d).filter("p_form IS NOT NULL").groupBy(FE.feats_match_script("g_feats", "p_feats").alias("ok")).agg(L.n())


@query("subset_of", ACC_SQL + "SELECT p_feats = '_' OR (g_feats <> '_' AND list_has_all(gf, pf)) AS ok, count(*) AS n FROM s WHERE p_form IS NOT NULL GROUP BY 1")
def _(spark, d):
    return pairs(spark, d).filter("p_form IS NOT NULL").groupBy(FE.subset_of("p_feats", "g_feats").alias("ok")).agg(L.n())


@query("head_join", GOLD_SQL + "SELECT h.form AS head_form, g.deprel, count(*) AS n FROM gold g LEFT JOIN gold h ON g.doc_id = h.doc_id AND g.sent_ord = h.sent_ord AND g.head = h.tok_ord + 1 GROUP BY ALL")
def _(spark, d):
    return M.head_join(gold(spark, d)).groupBy("head_form", "deprel").agg(L.n())


@query("align_gold_pred")
def _(spark, d):
    g = gold(spark, d).select("doc_id", "sent_ord", "tok_ord", "form")
    return A.align_gold_pred(g, g.filter("tok_ord % 7 <> 6"))


@query("sequence_align")
def _(spark, d):
    g = gold(spark, d).select("doc_id", "sent_ord", "tok_ord", "form")
    return A.sequence_align(g, g.filter("tok_ord % 7 <> 6"))


ENT_SQL = GOLD_SQL + """, ent AS (SELECT doc_id, sent_ord, tok_ord + 1 AS start, tok_ord + least(2, n_tok - tok_ord) AS "end", CASE WHEN tag LIKE 'V%' THEN 'PER' ELSE 'LOC' END AS label FROM gold WHERE length(form) > 9 AND tok_ord % 4 = 0)
"""


def ents(spark, d):
    g = gold(spark, d).filter("length(form) > 9 AND tok_ord % 4 = 0")
    return g.select("doc_id", "sent_ord", (F.col("tok_ord") + 1).alias("start"), (F.col("tok_ord") + F.least(F.lit(2), F.col("n_tok") - F.col("tok_ord"))).alias("end"), F.when(F.col("tag").startswith("V"), "PER").otherwise("LOC").alias("label"))


@query("entity_ids", ENT_SQL + "SELECT ne, count(*) AS n FROM (SELECT label || '_' || CAST(row_number() OVER (PARTITION BY doc_id, sent_ord, label ORDER BY start, \"end\") AS VARCHAR) AS ne FROM ent) GROUP BY ne")
def _(spark, d):
    return S.entity_ids(ents(spark, d)).groupBy("ne").agg(L.n())


IOB_SQL = ENT_SQL + """, iob AS (SELECT doc_id, sent_ord, p AS tok_ord, CASE WHEN p = start THEN 'B-' ELSE 'I-' END || label AS iob FROM (SELECT *, unnest(generate_series(start, "end")) AS p FROM ent))
"""


@query("entity_iob", IOB_SQL + "SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(tok_ord AS BIGINT) AS tok_ord, iob FROM iob")
def _(spark, d):
    return S.entity_iob(ents(spark, d)).select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), F.col("tok_ord").cast("bigint").alias("tok_ord"), "iob")


SPAN_SQL = IOB_SQL + ", full_ AS (SELECT g.doc_id, g.sent_ord, g.tok_ord + 1 AS tok_ord, coalesce(iob, 'O') AS iob, length(form) AS score FROM gold g LEFT JOIN iob i ON g.doc_id = i.doc_id AND g.sent_ord = i.sent_ord AND g.tok_ord + 1 = i.tok_ord)\n"
SPANS_ALL = SPAN_SQL + """, st AS (SELECT *, CASE WHEN iob LIKE 'B%' OR (iob LIKE 'I%' AND (lag(iob) OVER w IS NULL OR lag(iob) OVER w = 'O' OR substr(lag(iob) OVER w, 3) <> substr(iob, 3))) THEN 1 ELSE 0 END AS s FROM full_ WINDOW w AS (PARTITION BY doc_id, sent_ord ORDER BY tok_ord)),
gr AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, sent_ord ORDER BY tok_ord) AS g FROM st)
SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, substr(min(iob), 3) AS label, CAST(min(tok_ord) AS BIGINT) AS start, CAST(max(tok_ord) AS BIGINT) AS "end", round(avg(score), 6) AS score FROM gr WHERE iob <> 'O' GROUP BY doc_id, sent_ord, g"""


def iob_labels(spark, d):
    i = S.entity_iob(ents(spark, d))
    g = gold(spark, d).select("doc_id", "sent_ord", (F.col("tok_ord") + 1).alias("tok_ord"), F.char_length("form").alias("score"))
    return g.join(i, ["doc_id", "sent_ord", "tok_ord"], "left").withColumn("iob", F.coalesce("iob", F.lit("O")))


def _spans(spark, d):
    s = S.iob_to_spans(iob_labels(spark, d))
    return s.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("sent_ord", "start", "end")], "label", F.round("score", 6).alias("score"))


query("iob_to_spans", SPANS_ALL)(_spans)
query("ner_labels", SPANS_ALL)(lambda spark, d: _spans(spark, d))

OFF_SQL = TOK_SQL + """, ns AS (SELECT doc_id, sent_ord, count(*) AS n FROM tok GROUP BY ALL), ro AS (SELECT doc_id, sent_ord, n, sum(n) OVER (PARTITION BY doc_id ORDER BY sent_ord) - n + 1 AS first, sum(n) OVER (PARTITION BY doc_id ORDER BY sent_ord) AS last FROM ns)
"""


def offsets(spark, d):
    return S.running_offsets(tokens(spark, d).groupBy("doc_id", "sent_ord").agg(L.n()))


@query("running_offsets", OFF_SQL + "SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, n, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM ro")
def _(spark, d):
    return offsets(spark, d).withColumn("sent_ord", F.col("sent_ord").cast("bigint"))


_SPANS = "SELECT doc_id, k * 50 + 1 AS start, k * 50 + 1 + k % 9 AS \"end\", 'x' || CAST(k % 3 AS VARCHAR) AS label FROM (SELECT doc_id, unnest(generate_series(0, CAST((max(last) - 1) // 50 AS BIGINT))) AS k FROM ro GROUP BY doc_id)"


def doc_spans(spark, d):
    """A span at every fiftieth token of each document, to its end."""
    ends = offsets(spark, d).groupBy("doc_id").agg(F.max("last").alias("last"))
    k = ends.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("cast((last - 1) div 50 as int)"))).alias("k"))
    return k.select("doc_id", (F.col("k") * 50 + 1).alias("start"), (F.col("k") * 50 + 1 + F.col("k") % 9).alias("end"), F.concat(F.lit("x"), (F.col("k") % 3).cast("string")).alias("label"))


def _longs(df, *names):
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


@query("spans_to_sentences", OFF_SQL + f", sp AS ({_SPANS}) SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, label, CAST(start - first + 1 AS BIGINT) AS start, CAST(\"end\" - first + 1 AS BIGINT) AS \"end\" FROM sp JOIN ro USING (doc_id) WHERE start >= first AND \"end\" <= last")
def _(spark, d):
    return _longs(S.spans_to_sentences(doc_spans(spark, d), offsets(spark, d)), "sent_ord", "start", "end")


@query("markup_split", OFF_SQL + f", sp AS ({_SPANS}) SELECT doc_id, label, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(greatest(start, first) AS BIGINT) AS start, CAST(least(\"end\", last) AS BIGINT) AS \"end\" FROM sp JOIN ro USING (doc_id) WHERE start <= last AND \"end\" >= first")
def _(spark, d):
    return _longs(S.split_at_sentences(doc_spans(spark, d), offsets(spark, d)), "sent_ord", "start", "end")


def _sent_texts(spark, d):
    return explode_sentences(read(spark, d, "documents")).select("doc_id", "sent_ord", F.col("sent").alias("text"))


@query("token_offsets", SENT_SQL + r""", m AS (SELECT doc_id, sent_ord, regexp_extract_all(sent, '([\p{L}\p{N}\p{M}''_-]+|[^\s])\s?') AS f FROM sen),
x AS (SELECT doc_id, sent_ord, i - 1 AS tok_ord, length(f[i]) AS n, length(trim(f[i])) AS w FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM m))
SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(tok_ord AS BIGINT) AS tok_ord, CAST(sum(n) OVER (PARTITION BY doc_id, sent_ord ORDER BY tok_ord) - n AS BIGINT) AS start, CAST(sum(n) OVER (PARTITION BY doc_id, sent_ord ORDER BY tok_ord) - n + w AS BIGINT) AS "end" FROM x""")
def _(spark, d):
    return _longs(S.token_offsets(tokens(spark, d), _sent_texts(spark, d)), "sent_ord", "tok_ord")


@query("sentence_offsets", SENT_SQL + r"SELECT doc_id, CAST(sent_ord AS BIGINT) AS sent_ord, CAST(0 AS BIGINT) AS start, CAST(length(sent) AS BIGINT) AS end_ FROM sen")
def _(spark, d):
    o = S.sentence_offsets(S.token_offsets(tokens(spark, d), _sent_texts(spark, d)))
    return o.select("doc_id", F.col("sent_ord").cast("bigint").alias("sent_ord"), "start", F.col("end").alias("end_"))


IDS_SQL = "WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents), ro AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS r, count(*) OVER () AS t FROM ids), spl AS (SELECT id, CASE WHEN r <= floor(t * 0.8) THEN 'train' WHEN r <= floor(t * 0.8) + floor(t * 0.1) THEN 'dev' ELSE 'test' END AS split FROM ro)\n"


def doc_ids(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))


@query("split_cutpoints", IDS_SQL + "SELECT * FROM spl")
def _(spark, d):
    return SP.split_cutpoints(doc_ids(spark, d))


OLD_SQL = ", old AS (SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'test' WHEN CAST(id AS BIGINT) % 5 = 1 THEN 'dev' ELSE 'train' END AS split FROM ids WHERE CAST(id AS BIGINT) % 2 = 0)\n"


def old_split(spark, d):
    i = F.col("id").cast("bigint")
    return doc_ids(spark, d).filter(i % 2 == 0).select("id", F.when(i % 5 == 0, "test").when(i % 5 == 1, "dev").otherwise("train").alias("split"))


@query("preserve_splits", IDS_SQL.split(", ro AS")[0] + OLD_SQL + ", fresh AS (SELECT id FROM ids WHERE id NOT IN (SELECT id FROM old)), ro AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS r, count(*) OVER () AS t FROM fresh) SELECT * FROM old UNION ALL SELECT id, CASE WHEN r <= floor(t * 0.8) THEN 'train' WHEN r <= floor(t * 0.8) + floor(t * 0.1) THEN 'dev' ELSE 'test' END FROM ro")
def _(spark, d):
    return SP.preserve_splits(doc_ids(spark, d), old_split(spark, d))


@query("split_difference", IDS_SQL.split(", ro AS")[0] + OLD_SQL + "SELECT id FROM ids WHERE id NOT IN (SELECT id FROM old)")
def _(spark, d):
    return SP.split_difference(doc_ids(spark, d), old_split(spark, d))


# Result tables in the shape of ``lineitem`` and ``orders``, catalogs in that of ``part``.
RES_SQL = "WITH res AS (SELECT l_returnflag AS language, l_linestatus AS backend, CAST(l_suppkey AS VARCHAR) AS model, CAST(l_partkey AS VARCHAR) AS treebank, CAST(l_linenumber AS VARCHAR) AS mode, CASE WHEN l_quantity > 45 THEN NULL ELSE l_discount END AS upos, l_tax AS lemma, l_quantity AS size FROM lineitem)\n"


def results(spark, d):
    s = lambda c: F.col(c).cast("string")
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("language"), F.col("l_linestatus").alias("backend"), s("l_suppkey").alias("model"), s("l_partkey").alias("treebank"), s("l_linenumber").alias("mode"), F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_discount")).alias("upos"), F.col("l_tax").alias("lemma"), F.col("l_quantity").alias("size"))


@query("benchmark_average", RES_SQL + "SELECT language, backend, model, mode, round(avg(upos), 6) AS upos, round(avg(lemma), 6) AS lemma, min(size) AS size FROM res GROUP BY ALL")
def _(spark, d):
    return SP.benchmark_average(results(spark, d), ["upos", "lemma"]).withColumns({c: F.round(c, 6) for c in ("upos", "lemma")})


@query("upsert_result", RES_SQL + "SELECT language, backend, model, treebank, mode, upos, lemma, size FROM res WHERE (language, backend, model, treebank, mode) NOT IN (SELECT (language, backend, model, treebank, mode) FROM res WHERE CAST(model AS BIGINT) % 7 = 0) UNION ALL SELECT language, backend, model, treebank, mode, upos, lemma + 1, size FROM res WHERE CAST(model AS BIGINT) % 7 = 0")
def _(spark, d):
    r = results(spark, d)
    return SP.upsert_results(r, r.filter(F.col("model").cast("bigint") % 7 == 0).withColumn("lemma", F.col("lemma") + 1))


@query("sort_results", RES_SQL + "SELECT CAST(row_number() OVER (ORDER BY upos DESC NULLS LAST, language, backend, model, mode) AS BIGINT) AS rank, language, backend, model, mode, round(upos, 6) AS upos FROM (SELECT language, backend, model, mode, round(avg(upos), 6) AS upos FROM res GROUP BY ALL)")
def _(spark, d):
    a = SP.benchmark_average(results(spark, d), ["upos"]).withColumn("upos", F.round("upos", 6))
    return C.ranked(a, F.col("upos").desc_nulls_last(), "language", "backend", "model", "mode").select("rank", "language", "backend", "model", "mode", "upos")


@query("filter_results", RES_SQL + "SELECT language, backend, count(*) AS n FROM res WHERE lower(language) IN ('a', 'r') AND lower(backend) = 'f' GROUP BY ALL")
def _(spark, d):
    return C.filter_results(results(spark, d), language=["A", "r"], backend="F").groupBy("language", "backend").agg(L.n())


@query("read_benchmark_results", "SELECT event_type AS backend, count(*) AS n, round(avg(value), 4) AS metric FROM events GROUP BY 1")
def _(spark, d):
    from ..sources.results import parse_results

    e = read(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("backend"), F.struct(F.col("value").alias("upos")).alias("metrics"))).alias("value"))
    return parse_results(e).groupBy("backend").agg(L.n(), F.round(F.avg("upos"), 4).alias("metric"))


@query("result_entry", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice / (o_custkey % 5) END AS tps FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.try_divide("o_totalprice", F.col("o_custkey") % 5).alias("tps"))


CAT_SQL = "WITH cat AS (SELECT p_brand AS language, split_part(p_type, ' ', 1) AS backend, p_name || '-' || CAST(p_partkey AS VARCHAR) AS model, p_size > 25 AS installed FROM part)\n"


def catalog(spark, d):
    return read(spark, d, "part").select(F.col("p_brand").alias("language"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("backend"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("model"), (F.col("p_size") > 25).alias("installed"))


ORDER = ["SMALL", "LARGE", "MEDIUM"]
PREF_SQL = CAT_SQL + ", pr AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY installed DESC, CASE backend WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END, model) = 1 AS preferred FROM {cat})\n"


@query("preferred_model", PREF_SQL.replace("{cat}", "cat") + "SELECT * FROM pr")
def _(spark, d):
    return C.preferred_model(catalog(spark, d), ORDER)


DIS_SQL = CAT_SQL + ", en AS (SELECT * FROM cat WHERE NOT (installed AND backend = 'SMALL'))\n"


def enabled(spark, d):
    c = catalog(spark, d)
    return C.exclude_disabled(c, c.filter("installed AND backend = 'SMALL'").select("backend", "model"))


@query("exclude_disabled", DIS_SQL + "SELECT * FROM en")
def _(spark, d):
    return enabled(spark, d)


_PICK = DIS_SQL + PREF_SQL.split("\n", 1)[1].replace("{cat}", "en") + "SELECT language, backend, model FROM pr WHERE preferred"
query("language_backend_pick", _PICK)(lambda spark, d: C.preferred_model(enabled(spark, d), ORDER).filter("preferred").select("language", "backend", "model"))
query("auto_select", _PICK)(lambda spark, d: C.preferred_model(enabled(spark, d), ORDER).filter("preferred").select("language", "backend", "model"))


@query("merge_registries", "WITH l AS (SELECT p_name AS model, min(p_brand) AS language, min(p_type) AS path FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), r AS (SELECT p_name AS model, max(p_brand) AS language, max(p_type) AS path FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1) SELECT coalesce(l.model, r.model) AS model, coalesce(r.language, l.language) AS language, coalesce(l.path, r.path) AS path FROM l FULL JOIN r ON l.model = r.model")
def _(spark, d):
    p = read(spark, d, "part")
    side = lambda k, f: p.filter(F.col("p_partkey") % 3 != k).groupBy(F.col("p_name").alias("model")).agg(f("p_brand").alias("language"), f("p_type").alias("path"))
    return C.merge_registries(side(0, F.min), side(1, F.max))


@query("language_coverage", CAT_SQL + ", m AS (SELECT language, count(*) AS a FROM cat WHERE installed GROUP BY 1), t AS (SELECT language, count(*) AS b FROM cat WHERE backend = 'LARGE' GROUP BY 1) SELECT coalesce(m.language, t.language) AS language, coalesce(a, 0) AS n_models, coalesce(b, 0) AS n_tests, coalesce(a, 0) * coalesce(b, 0) AS runs FROM m FULL JOIN t ON m.language = t.language")
def _(spark, d):
    c = catalog(spark, d)
    return C.language_coverage(c.filter("installed"), c.filter("backend = 'LARGE'"))


@query("list_languages", CAT_SQL + "SELECT language, count(*) AS n_models, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends FROM cat GROUP BY 1")
def _(spark, d):
    return C.list_languages(catalog(spark, d))


@query("list_models", CAT_SQL + "SELECT CAST(row_number() OVER (ORDER BY language, backend, model) AS BIGINT) AS rank, language, backend, model FROM cat WHERE installed")
def _(spark, d):
    c = catalog(spark, d).filter("installed").select("language", "backend", "model")
    return C.ranked(c, "language", "backend", "model")


@query("language_union", "SELECT n_name AS language FROM nation UNION SELECT r_name FROM region")
def _(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("language")).union(read(spark, d, "region").select("r_name")).distinct()


@query("treebank_limit", "SELECT n_name FROM nation ORDER BY n_name LIMIT 7")
def _(spark, d):
    return read(spark, d, "nation").select("n_name").orderBy("n_name").limit(7)


def languages(spark, d):
    return read(spark, d, "nation").select(F.lower(F.left("n_name", F.lit(2))).alias("iso"), F.col("n_name").alias("name"))


@query("resolve_language", "SELECT n_name AS name, lower(left(n_name, 2)) AS iso FROM nation WHERE lower(n_name) IN ('france', 'nation_3', 'germany') OR lower(left(n_name, 2)) IN ('fr', 'na')")
def _(spark, d):
    return languages(spark, d).filter(F.lower("name").isin("france", "nation_3", "germany") | F.col("iso").isin("fr", "na")).select("name", "iso")


@query("language_match")
def _(spark, d):
    return C.language_match(languages(spark, d), "NATION_11X")


@query("similar_languages")
def _(spark, d):
    return C.similar_languages(languages(spark, d), "NATION_11X")


@query("merge_by_confidence", BEST_SQL + "SELECT CASE WHEN coalesce(freq, 0) / (coalesce(freq, 0) + CAST(1 AS DOUBLE)) >= 0.75 THEN p_upos ELSE g_upos END AS upos, count(*) AS n FROM pairs WHERE p_form IS NOT NULL GROUP BY 1")
def _(spark, d):
    conf = F.coalesce(F.col("freq"), F.lit(0)) / (F.coalesce(F.col("freq"), F.lit(0)) + 1)
    p = pairs(spark, d).filter("p_form IS NOT NULL")
    return p.groupBy(F.when(conf >= 0.75, F.col("p_upos")).otherwise(F.col("g_upos")).alias("upos")).agg(L.n())


@query("scan_union", GOLD_SQL + "SELECT lang, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM gold GROUP BY lang")
def _(spark, d):
    return gold(spark, d).groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


REPO_SQL = GOLD_SQL + "SELECT tag, CASE WHEN tag IN ('PUNCT', 'NUM') THEN 'standard' ELSE 'extended' END AS kind, string_agg(DISTINCT lang, ',' ORDER BY lang) AS treebanks, count(*) AS n FROM gold GROUP BY tag"


def _repo(spark, d):
    kind = F.when(F.col("tag").isin("PUNCT", "NUM"), "standard").otherwise("extended")
    return gold(spark, d).groupBy("tag", kind.alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("treebanks"), L.n())


query("ud_repository", REPO_SQL)(_repo)
query("list_ud_tags", REPO_SQL + " HAVING tag NOT IN ('PUNCT', 'NUM')")(lambda spark, d: _repo(spark, d).filter("kind = 'extended'"))
