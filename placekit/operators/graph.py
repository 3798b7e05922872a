"""Connected components by alternating large-star and small-star steps.

Both steps are a grouped minimum (combined map-side) and an equi-join, so a node linked to a
third of all others never gathers its neighbours in one task. See Kiveris et al., "Connected
Components in MapReduce and Beyond" (2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.plans.session import cut, is_empty


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(moved.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """Node -> smallest node of its component, from undirected edges (a, b); loops name lone nodes."""
    edges = cut(edges.select("a", "b").distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    cur = cut(edges.where(F.col("a") != F.col("b")))
    while True:
        nxt = cut(_small_star(_large_star(cur)))
        # finished when every node points straight at a root: no pointed-at node points on
        chained = nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi")
        forked = nxt.groupBy("a").count().where(F.col("count") > 1)
        cur = nxt
        if is_empty(chained) and is_empty(forked):
            break
    return nodes.join(cur.select(F.col("a").alias("node"), F.col("b").alias("_l")), "node", "left").select(
        "node", F.coalesce("_l", "node").alias("label"))
