"""Corpus pipeline: five operators of the training-data subpackage, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last adds token ids. Rows whose text is null pass the
filters: they are neither toxic nor contaminated, and have no tokens; all texts
without words count as near duplicates of each other, so one of them stays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import bpe, common, decontaminate, near_dedup, secrets, toxicity

#: A document of which more than this share of words is benchmark text goes whole.
MAX_COVERAGE = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of texts whose
    five-word shingles have a Jaccard similarity of 0.8 or more: SimHash and MinHash propose."""
    return near_dedup.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such go."""
    return decontaminate.remove_spans(docs, common.table(spark, sf_dir, "benchmark"), max_coverage=MAX_COVERAGE)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret replaced by its kind."""
    return secrets.redact_secrets(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every text that is left."""
    return bpe.encode_documents(docs, keep=("doc_id", "lang", "source"), with_digests=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: Models and compression have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
