"""Connected components of an edge table by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import cut


def _sym(e: DataFrame) -> DataFrame:
    return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    s = _sym(e)
    low = s.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return s.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    d = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = d.groupBy("a").agg(F.min("b").alias("m"))
    moved = d.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component): the smallest node reachable, for nodes with an edge.

    Each round is two aggregations and two joins; a hub's rows are pre-aggregated by ``min`` and
    joined to one row, so that adaptive skew joins can split them. Rounds grow with the logarithm
    of a component's diameter. Null ends and loops are ignored. The edge table is written to the
    shared folder after each round.
    """
    e = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while True:
        e = cut(_small_star(_large_star(e)))
        # a fixpoint is a forest of stars: every node points to one root and no root points on
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == was:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(e.select("b", "b").distinct())
        was = now
