"""Connected components by alternating large-star and small-star rounds, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of edges; the component is its smallest node. Loops and nulls are left out.

    Each round points nodes at the smallest neighbour that they know, so rounds grow with the logarithm of the
    longest chain. Rounds are written to the shared folder; the driver sees a count and a sum of hashes only.
    A hub with many neighbours is one row of a partial aggregate and the skewed side of an equi-join.
    """
    x, y = F.col(a), F.col(b)
    now = stored(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before, mark = None, _mark(now)
    while mark != before:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least).distinct()
        old, now = now, stored(small, "edges")
        discard(old)
        before, mark = mark, _mark(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
