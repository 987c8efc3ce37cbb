"""UniMorph-style lexicons: lemma, form and feature codes, tab-separated."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.feats import unimorph_to_ud


def parse_unimorph_lines(lines: DataFrame) -> DataFrame:
    """lemma (lower case), form, codes, upos, feats of ``value`` lines; comments and
    lines of fewer than three fields are skipped."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(f.alias("f")).filter(F.size("f") >= 3)
    out = rows.select(F.lower(F.col("f")[0]).alias("lemma"), F.col("f")[1].alias("form"), F.col("f")[2].alias("codes"))
    return out.withColumn("u", unimorph_to_ud("codes")).select("lemma", "form", "codes", "u.upos", "u.feats")


def read_unimorph(spark: SparkSession, path: str) -> DataFrame:
    return parse_unimorph_lines(spark.read.text(path))


def lexicon_entries(lexicon: DataFrame, default_count: int = 1) -> DataFrame:
    """The lexicon as model entries: form, lemma, tag, feats, n."""
    return lexicon.select("form", "lemma", F.col("upos").alias("tag"), "feats", F.lit(default_count).cast("bigint").alias("n"))
