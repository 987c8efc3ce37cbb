"""Connected components of a graph given as edges, in rounds of joins.

Alternating large-star and small-star steps (Kiveris et al., 2014): every vertex
ends up linked to the smallest vertex of its component. Hot vertices are only
ever aggregated (partially, before the shuffle) or on the side of a join that
adaptive execution can split. Lineage is cut by tables in the shared folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

MAX_ROUNDS = 60


def _lowest(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumnRenamed("u", "_u")
    out = both.filter("v > u").join(low, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = _lowest(down).withColumnRenamed("u", "_u")
    joined = down.join(low, F.col("u") == F.col("_u"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v): each vertex that has an edge and isn't the smallest of its
    component, with that smallest vertex. ``edges`` has columns u and v; loops and
    repeated edges don't matter, and an empty table gives an empty one."""
    edges = stored(edges.select("u", "v").filter("u != v").distinct(), name)
    before = None
    for _ in range(MAX_ROUNDS):
        old, edges = edges, stored(_small_star(_large_star(edges)), name)
        drop_stored(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges
        before = tuple(now)
    raise RuntimeError("components did not settle")
