"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import saved


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; root is its smallest.

    Each round hangs the tree of a node under the smallest root next to it and
    then halves every path, so the number of rounds grows with the logarithm of
    the longest chain. A round is three joins and one partial aggregate: no list
    of neighbours is ever built, and a node with many edges is a skewed join, which
    adaptive execution splits. Parents live in the shared folder between rounds.
    """
    edges = saved(edges.where("a <> b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    parents = saved(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("parent")),
        "parents",
    )
    while True:
        # the smallest grandparent among the neighbours, for a node and for its parent
        grand = parents.alias("p").join(
            parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent"
        ).select("node", "parent", "grand")
        near = (
            both.join(grand, both["b"] == grand["node"])
            .groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("near"))
        )
        seen = grand.join(near, "node").select(
            "node", "parent", "grand", F.least("grand", "near").alias("low")
        )
        hung = seen.select("node", "low").union(seen.select(F.col("parent").alias("node"), "low"))
        after = hung.groupBy("node").agg(F.min("low").alias("parent"))
        after = saved(after, "parents")
        changed = after.join(parents.withColumnRenamed("parent", "was"), "node").where("parent <> was")
        if changed.isEmpty():
            return after.select("node", F.col("parent").alias("root"))
        parents = after
