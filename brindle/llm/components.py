"""Connected components of a link table, by alternating large and small stars.

Every step is a grouped minimum and a join, each written to the shared folder, so
nothing is gathered and a lost executor costs one step. The number of rounds is
logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and all its neighbours. Both sides of the join are read from tables, so
    a hub's rows can be split between tasks."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> node, root for every linked node: root is the least node of its component."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _least(large)
        new = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        # Done when a round changes nothing: every edge then points at its root.
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, large)
        edges = new
        if tuple(now) == size:
            break
        size = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
