"""Scoring of predicted against gold annotations, over aligned token pairs.

Columns come in pairs: ``g_x`` of the gold, ``p_x`` of the predicted token; a gold
token without a partner has nulls on the predicted side.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.feats import feats_partial_match


def _filled(c):
    return F.coalesce(~c.isin("", "_"), F.lit(False))


def accuracy_metrics(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, metric, correct, total. One pass: all metrics are conditional counts.

    tokenization counts aligned gold tokens only; a field counts where gold has it;
    feats count for every token; feats_partial where either side has any.
    """
    g, p = (lambda x: F.col(f"g_{x}")), (lambda x: F.col(f"p_{x}"))
    aligned = p("form").isNotNull()
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("_")), F.lit(""))
    same = lambda x: F.coalesce(g(x) == p(x), F.lit(False))
    scores = {"tokenization": (aligned, same("form"))}
    for x in ("upos", "xpos", "lemma", "reg"):
        scores[x] = (_filled(g(x)), same(x))
    equal_feats = aligned & (blank(g("feats")) == blank(p("feats")))
    scores["feats"] = (F.lit(True), equal_feats)
    partial = F.coalesce(aligned & feats_partial_match("g_feats", "p_feats"), F.lit(False))
    scores["feats_partial"] = (_filled(g("feats")) | _filled(p("feats")), partial)
    scores["upos+feats"] = (_filled(g("upos")) | _filled(g("feats")), same("upos") & equal_feats)
    counts = [x for i, (of, right) in enumerate(scores.values()) for x in (F.count_if(of & right).alias(f"_c{i}"), F.count_if(of).alias(f"_t{i}"))]
    grouped = pairs.groupBy(*by).agg(*counts) if by else pairs.agg(*counts)
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"_c{i}").alias("correct"), F.col(f"_t{i}").alias("total")) for i, k in enumerate(scores)])
    return grouped.select(*by, F.explode(rows).alias("r")).select(*by, "r.metric", "r.correct", "r.total")


def head_join(tokens: DataFrame) -> DataFrame:
    """tokens with head_form and head_ord: the token that head (1-based, 0: root) names."""
    h = tokens.select("doc_id", "sent_ord", (F.col("tok_ord") + 1).alias("_id"), F.col("form").alias("head_form"), F.col("tok_ord").alias("head_ord"))
    t = tokens.withColumn("_id", F.col("head"))
    return t.join(h, ["doc_id", "sent_ord", "_id"], "left").drop("_id")


def attachment_scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """uas, las, n over aligned pairs that both have a deprel.

    Heads agree if both are 0, or if neither is and the predicted head is the token that the
    gold head is aligned with: ``g_id`` and ``p_id`` (from 1, in their own sentences) say which
    is which, so insertions and deletions don't matter. One shuffle by sentence.
    """
    sentence = Window.partitionBy("doc_id", "sent_ord")
    entry = F.when(F.col("p_id").isNotNull(), F.struct("g_id", "p_id"))
    partner = F.try_element_at(F.map_from_entries(F.collect_list(entry).over(sentence)), F.col("g_head"))
    g, p = F.col("g_head"), F.col("p_head")
    head = F.coalesce(((g == 0) & (p == 0)) | ((g > 0) & (p > 0) & (partner == p)), F.lit(False))
    las = head & (F.col("g_deprel") == F.col("p_deprel"))
    marked = pairs.select(*by, "g_deprel", "p_deprel", head.alias("head"), las.alias("las"))
    both = marked.filter(_filled(F.col("g_deprel")) & _filled(F.col("p_deprel")))
    rate = lambda c: F.try_divide(F.count_if(c), F.count(F.lit(1)))
    return (both.groupBy(*by) if by else both).agg(rate(F.col("head")).alias("uas"), rate(F.col("las")).alias("las"), F.count(F.lit(1)).alias("n"))


def split_scores(words: DataFrame) -> DataFrame:
    """recall, precision, form accuracy of splits; ``g_parts``, ``p_parts`` arrays (null: not split)."""
    g, p = F.col("g_parts").isNotNull(), F.col("p_parts").isNotNull()
    n = F.count_if
    return words.agg(
        F.try_divide(n(g & p), n(g)).alias("recall"), F.try_divide(n(g & p), n(p)).alias("precision"),
        F.try_divide(n(g & p & (F.col("g_parts") == F.col("p_parts"))), n(g & p)).alias("form_accuracy"),
    )


BUCKETS = {
    "length": lambda: _bucket(F.char_length("g_form"), (3, "1-3"), (6, "4-6"), (10, "7-10"), (None, "11+")),
    "frequency": lambda: _bucket(F.coalesce(F.col("freq"), F.lit(0)), (0, "0"), (4, "1-4"), (19, "5-19"), (99, "20-99"), (None, "100+")),
    "position": lambda: _bucket(F.floor(F.col("tok_ord") / 20), (0, "start"), (1, "early"), (2, "middle"), (None, "late")),
}


def _bucket(c, *steps):
    out = F.lit(steps[-1][1])
    for limit, name in reversed(steps[:-1]):
        out = F.when(c <= limit, name).otherwise(out)
    return out


def error_breakdown(pairs: DataFrame) -> DataFrame:
    """dimension, bucket, correct, total of tags: by OOV, length, frequency, position,
    and the crosstab of OOV and length: one aggregation over grouping sets."""
    marked = pairs.select(
        F.when(F.coalesce(F.col("freq"), F.lit(0)) == 0, "oov").otherwise("known").alias("oov"),
        *[make().alias(k) for k, make in BUCKETS.items()],
        F.coalesce(F.col("g_upos") == F.col("p_upos"), F.lit(False)).alias("ok"),
    )
    names = ["oov", *BUCKETS]
    # A cube of pre-aggregated counts: the shuffle carries one row a combination and task.
    base = marked.groupBy(*names).agg(F.count_if("ok").alias("correct"), F.count(F.lit(1)).alias("total"))
    sets = [[F.col(n)] for n in names] + [[F.col("oov"), F.col("length")]]
    g = base.groupingSets(sets, *[F.col(n) for n in names]).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.grouping_id(*names).alias("_g"))
    label = F.lit("oov*length")
    for i, n in enumerate(names):
        label = F.when(F.col("_g") == (15 ^ (8 >> i)), n).otherwise(label)
    return g.select(label.alias("dimension"), F.concat_ws("/", *names).alias("bucket"), "correct", "total")


def candidate_accuracy(pairs: DataFrame) -> DataFrame:
    ok = lambda x: F.avg(F.when(F.col(f"g_{x}") == F.col(f"p_{x}"), 1.0).otherwise(0.0))
    return pairs.agg(ok("upos").alias("pos_accuracy"), ok("lemma").alias("lemma_accuracy"))
