"""Connected components by alternating large-star and small-star steps; every step is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in edges (u, v); self-links alone give no row.

    Grouping is by partial minima and the joins are equi-joins whose large sides AQE can split, so that a node with
    very many links is no bottleneck. The number of rounds grows with the logarithm of the number of nodes.
    """
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own smallest neighbour below it is kept, so that no component falls apart
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
