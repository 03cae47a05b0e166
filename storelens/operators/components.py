"""Connected components by alternating large-star and small-star steps.

Every step is a min-aggregate per node and a join back, so a hot node is
pre-aggregated before the shuffle and its edges can be split in the join; the
number of rounds grows with the logarithm of the longest chain, without a cap.
The rounds end when the edges are a forest of stars: then every node hangs on one
root and no root hangs on another.  Nodes are of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.sizing import cut_lineage


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang each node's neighbours (``larger``: those above it, else all of the
    given, smaller ones and itself) on the smallest of the node and its neighbours."""
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    joined = pairs.join(least, "a")
    if larger:
        hung = joined.where(F.col("b") > F.col("a"))
    else:
        own = least.select("a", F.col("a").alias("b"), "root")
        hung = joined.where(F.col("b") != F.col("root")).unionByName(own)
    return hung.select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b").distinct()


def _forest(state: DataFrame) -> tuple[bool, int]:
    """Whether the edges (node, smaller node) are stars: no node has two of them,
    and none that has one is another's.  And the number of edges."""
    ends = state.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        state.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    # an aggregate reads all partitions in one job; a limit would try a few more at a time
    crossed, edges = each.agg(F.count_if(F.expr("up > 1 or (up = 1 and down = 1)")), F.sum("up")).first()
    return not crossed, edges or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node
    that occurs in an edge.  Loops and repeated edges are allowed; null ends are
    dropped; no edges give an empty result."""
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    # oriented: a > b; a loop is kept as it is and says that its node occurs
    state = cut_lineage(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = state.where("a = b")
    state = state.where("a != b")
    while not (found := _forest(state))[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a step never has more edges than there were
        hung = cut_lineage(_star(both, larger=True), rows=found[1])
        state = cut_lineage(_star(hung, larger=False), rows=found[1])
    every = state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root"))).unionByName(
        loops.select(F.col("a").alias("node"), F.col("b").alias("root")))
    return every.groupBy("node").agg(F.min("root").alias("root"))
