"""Spans and offsets: entities, running offsets, IOB labels, markup ranges."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_ids(entities: DataFrame) -> DataFrame:
    """entities with ``ne``: LABEL_n, the n-th of its label in the sentence."""
    w = Window.partitionBy("doc_id", "sent_ord", "label").orderBy("start", "end")
    return entities.withColumn("ne", F.concat_ws("_", "label", F.row_number().over(w).cast("string")))


def entity_iob(entities: DataFrame) -> DataFrame:
    """doc_id, sent_ord, tok_ord, iob: B- on a span's first token, I- on the rest."""
    e = entities.select("doc_id", "sent_ord", "start", "label", F.explode(F.sequence("start", "end")).alias("tok_ord"))
    return e.select("doc_id", "sent_ord", "tok_ord", F.concat(F.when(F.col("tok_ord") == F.col("start"), "B-").otherwise("I-"), "label").alias("iob"))


def iob_to_spans(labels: DataFrame) -> DataFrame:
    """doc_id, sent_ord, label, start, end, score of IOB labels: gaps and islands.
    An I- without a span of its label before it starts one."""
    w = Window.partitionBy("doc_id", "sent_ord").orderBy("tok_ord")
    kind, name = F.substring("iob", 1, 1), F.expr("substring(iob, 3)")
    t = labels.withColumns({"_k": kind, "_n": name})
    before_k, before_n = F.lag("_k").over(w), F.lag("_n").over(w)
    start = (F.col("_k") == "B") | ((F.col("_k") == "I") & (before_k.isNull() | (before_k == "O") | (before_n != F.col("_n"))))
    t = t.withColumn("_s", F.when(start, 1).otherwise(0)).withColumn("_g", F.sum("_s").over(w)).filter("_k <> 'O'")
    g = t.groupBy("doc_id", "sent_ord", "_g")
    return g.agg(F.first("_n").alias("label"), F.min("tok_ord").alias("start"), F.max("tok_ord").alias("end"), F.avg("score").alias("score")).drop("_g")


def running_offsets(sentences: DataFrame) -> DataFrame:
    """sentences (doc_id, sent_ord, n) with first, last: their tokens' places in the document."""
    w = Window.partitionBy("doc_id").orderBy("sent_ord").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("last", F.sum("n").over(w)).withColumn("first", F.col("last") - F.col("n") + 1)


def spans_to_sentences(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Document spans (doc_id, start, end, label) inside one sentence, with places in it.
    The equality on doc_id keeps the range join within a document."""
    s = sentences.select("doc_id", "sent_ord", "first", "last")
    inside = (F.col("start") >= F.col("first")) & (F.col("end") <= F.col("last"))
    return spans.join(s, "doc_id").filter(inside).select("doc_id", "sent_ord", "label", (F.col("start") - F.col("first") + 1).alias("start"), (F.col("end") - F.col("first") + 1).alias("end"))


def split_at_sentences(markup: DataFrame, sentences: DataFrame) -> DataFrame:
    """Markup spans cut at sentence boundaries: the part of each in each sentence."""
    s = sentences.select("doc_id", "sent_ord", "first", "last")
    over = (F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first"))
    return markup.join(s, "doc_id").filter(over).select("doc_id", "label", "sent_ord", F.greatest("start", "first").alias("start"), F.least("end", "last").alias("end"))


def token_offsets(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, sent_ord, tok_ord, start, end: where each form is found in its sentence's
    ``text``, greedily from left to right (code points from 0; null if nowhere)."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for r in f.itertuples():
                at = 0
                low = r.text.lower()
                for t in r.toks:
                    p = r.text.find(t["form"], at)
                    p = p if p >= 0 else low.find(t["form"].lower(), at)
                    rows.append((r.doc_id, r.sent_ord, t["tok_ord"], p if p >= 0 else None, p + len(t["form"]) if p >= 0 else None))
                    at = p + len(t["form"]) if p >= 0 else at
            yield pd.DataFrame(rows, columns=["doc_id", "sent_ord", "tok_ord", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    s = tokens.groupBy("doc_id", "sent_ord").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "form"))).alias("toks"))
    return s.join(texts, ["doc_id", "sent_ord"]).mapInPandas(run, "doc_id bigint, sent_ord int, tok_ord int, start bigint, end bigint")


def sentence_offsets(offsets: DataFrame) -> DataFrame:
    """doc_id, sent_ord, start, end: from a sentence's first token to its last."""
    return offsets.groupBy("doc_id", "sent_ord").agg(F.min("start").alias("start"), F.max("end").alias("end"))
