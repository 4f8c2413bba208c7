"""Connected components of an edge table, as Spark joins and groupings.

Alternates the large-star and small-star steps until nothing changes; every
step moves at most one row per edge and groups with a map-side minimum, and
each result is written to the shared folder, so neither a long lineage nor a
whole component ever sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of each node to the smallest of node and neighbours:
    the larger neighbours (large star), or the smaller ones and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        linked = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        linked = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of a sortable
    type); root is the smallest node that can be reached."""
    now = write_table(edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = None
    while True:
        large = write_table(_star(now, True), "cc-large")
        drop_table(now)
        now = write_table(_star(large, False), "cc")
        drop_table(large)
        # stars are reached when a step leaves the edge set as it is
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
