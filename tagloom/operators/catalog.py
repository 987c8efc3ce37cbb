"""Model catalogs: merging registries, preferences, language matching."""
from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..storage import stored


def merge_registries(local: DataFrame, remote: DataFrame) -> DataFrame:
    """model, language, path: local wins, remote adds what is missing; language is remote's."""
    r = remote.select(F.col("model").alias("_m"), F.col("language").alias("_l"), F.col("path").alias("_p"))
    j = local.join(r, F.col("model") == F.col("_m"), "full_outer")
    return j.select(F.coalesce("model", "_m").alias("model"), F.coalesce("_l", "language").alias("language"), F.coalesce("path", "_p").alias("path"))


def preferred_model(catalog: DataFrame, backend_order: list[str]) -> DataFrame:
    """catalog with ``preferred``: per language installed first, then backend, then name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(b) for b in backend_order]), F.col("backend")), F.lit(0))
    rank = F.when(rank == 0, len(backend_order) + 1).otherwise(rank)
    w = Window.partitionBy("language").orderBy(F.desc("installed"), rank, "model")
    return catalog.withColumn("preferred", F.row_number().over(w) == 1)


def exclude_disabled(catalog: DataFrame, disabled: DataFrame) -> DataFrame:
    return catalog.join(disabled, ["backend", "model"], "left_anti")


def language_coverage(models: DataFrame, tests: DataFrame) -> DataFrame:
    """language, n_models, n_tests, runs."""
    m = models.groupBy("language").agg(F.count(F.lit(1)).alias("n_models"))
    t = tests.groupBy("language").agg(F.count(F.lit(1)).alias("n_tests"))
    z = lambda c: F.coalesce(c, F.lit(0))
    j = m.join(t, "language", "full_outer")
    return j.select("language", z("n_models").alias("n_models"), z("n_tests").alias("n_tests"), (z("n_models") * z("n_tests")).alias("runs"))


def list_languages(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("language").agg(F.count(F.lit(1)).alias("n_models"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"))


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def language_match(entries: DataFrame, query: str, fuzzy: bool = True, threshold: float = 0.65) -> DataFrame:
    """Entries (iso, name) whose code or name is ``query``, or whose name is like it."""
    q = query.strip().lower()
    exact = (F.lower("iso") == q) | (F.lower("name") == q)
    if not fuzzy or len(q) <= 3:
        return entries.filter(exact)
    near = F.abs(F.char_length("name") - len(q)) <= F.lit(len(q))
    return entries.filter(exact | near).filter(exact | (name_ratio(F.lower("name"), F.lit(q)) >= threshold))


def similar_languages(entries: DataFrame, query: str, k: int = 3, threshold: float = 0.65) -> DataFrame:
    """name, ratio: the k most similar names; codes of 2 or 3 letters have none."""
    r = entries.select("name").distinct().withColumn("ratio", name_ratio(F.lower("name"), F.lit(query.lower())))
    return r.filter((F.col("ratio") >= threshold) & F.lit(len(query) > 3)).orderBy(F.desc("ratio"), "name").limit(k)


def sort_results(results: DataFrame, metric: str = "upos") -> DataFrame:
    return results.orderBy(F.col(metric).desc_nulls_last())


def filter_results(results: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns are, whatever their case, among the wanted values."""
    for name, values in wanted.items():
        values = [values] if isinstance(values, str) else values
        results = results.filter(F.lower(name).isin(*[v.lower() for v in values]))
    return results


def ranked(df: DataFrame, *order, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with its rank (from 1) in a total order, without one task that sorts all rows: rows are
    dealt to ranges of the order, numbered in each, and the counts of the ranges before are added.
    The sorted ranges are written once, so that both uses see the same ones (a job runs)."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(base), "_p").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_p", "_own", "_before")
