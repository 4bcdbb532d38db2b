"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by-minimum and an equi-join back, so a hub with many edges is pre-aggregated before the shuffle
and its join can be split where it is skewed. Lineage is cut after each step by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(shuffled(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _unfinished(edges: DataFrame) -> DataFrame:
    """Nodes that show that the edges aren't stars yet: with two edges, or with one that leads to a node with one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or out = 1 and in = 1")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type -> (a, root) for every node that isn't the least of its component."""
    state = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _unfinished(state).isEmpty():
        state = stored(_small_star(_large_star(state)), "edges")
    return state.select("a", F.col("b").alias("root"))
