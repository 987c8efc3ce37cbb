"""The stateless operators over Structured Streaming sources."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import explode_sentences, explode_tokens


def stream_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, lang string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def stream_tokens(documents: DataFrame) -> DataFrame:
    """Tokens of a stream of documents: projections only, so no state."""
    return explode_tokens(explode_sentences(documents))


def stream_form_counts(documents: DataFrame, ts: str | None = None, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of forms; with an event time by window, under a watermark that bounds the state."""
    if ts is None:
        return stream_tokens(documents).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    d = documents.withWatermark(ts, late)
    t = d.select(ts, F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}\p{M}'_-]+|[^\s]"), F.lit(0))).alias("form"))
    return t.groupBy(F.window(ts, window), "form").agg(F.count(F.lit(1)).alias("n"))
