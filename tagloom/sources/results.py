"""Benchmark results as JSON lines; what can't be parsed is dropped."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "language string, backend string, model string, treebank string, mode string, "
    "metrics struct<upos:double,xpos:double,feats_partial:double,lemma:double>, uas double, las double, "
    "tokens_per_second double, model_size_bytes bigint"
)


def parse_results(lines: DataFrame) -> DataFrame:
    r = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).filter("r IS NOT NULL")
    return r.select("r.*").select("*", "metrics.*").drop("metrics")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).select("*", "metrics.*").drop("metrics")
