"""Connected components by alternating large-star and small-star rounds over an edge table.

Every round is two aggregations and two joins on the edges, written to the shared folder; nothing is gathered. Rounds grow with the
square of the logarithm of the nodes at most, so no limit is set.
Each round hangs nodes on smaller neighbours, so the table ends as stars around each component's least node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: all greater neighbours of a node move to the least of its neighbours and itself. Small: so do the node and its
    smaller neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node that an edge (a, b) names. Saved."""
    state = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:  # ends: every round that changes the table hangs some node on a smaller one
        new = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
        state = saved(_star(_star(state, True), False), "edges", drop=(state,))
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return saved(roots, "roots", drop=(state,))
