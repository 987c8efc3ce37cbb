"""Stable train/dev/test splits and keyed result tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_cutpoints(ids: DataFrame, train: float = 0.8, dev: float = 0.1, seed: str = "42") -> DataFrame:
    """id, split: shares of the ids in the order of a seeded hash.

    The order is total, but only its ranks within hash ranges are windowed: counts
    of 256 prefixes give each range its offset, so no task sorts all ids.
    """
    h = ids.select("id", F.md5(F.concat_ws(":", "id", F.lit(seed))).alias("h")).withColumn("b", F.substring("h", 1, 2))
    size = h.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    base = size.select("b", (F.sum("m").over(Window.orderBy("b")) - F.col("m")).alias("base"), F.sum("m").over(Window.partitionBy()).alias("total"))
    r = h.join(F.broadcast(base), "b").withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy("h", "id")) + F.col("base"))
    a, b = F.floor(F.col("total") * train), F.floor(F.col("total") * dev)
    return r.select("id", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "dev").otherwise("test").alias("split"))


def preserve_splits(ids: DataFrame, old: DataFrame, **options) -> DataFrame:
    """Old assignments stay (test, then dev, then train wins); new ids are split anew."""
    rank = F.when(F.col("split") == "test", 0).when(F.col("split") == "dev", 1).otherwise(2)
    kept = old.groupBy("id").agg(F.min_by("split", rank).alias("split")).join(ids.select("id").distinct(), "id", "left_semi")
    fresh = ids.select("id").distinct().join(old.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(split_cutpoints(fresh, **options))


def split_difference(ids: DataFrame, old: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(old.select("id").distinct(), "id", "left_anti")


RESULT_KEY = ["language", "backend", "model", "treebank", "mode"]


def upsert_results(old: DataFrame, new: DataFrame, key=RESULT_KEY) -> DataFrame:
    """old without the keys of new, and new; of repeated new keys all rows stay."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def benchmark_average(results: DataFrame, metrics: list[str], key=("language", "backend", "model", "mode")) -> DataFrame:
    return results.groupBy(*key).agg(*[F.avg(m).alias(m) for m in metrics], F.min("size").alias("size"))
