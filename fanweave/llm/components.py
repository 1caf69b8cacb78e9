"""Connected components of a distributed graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanweave.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (
        both.join(least, "a").filter("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(least.select("a", F.col("least").alias("b"))).filter("a <> b")


def _state(edges: DataFrame) -> tuple:
    pair = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(pair)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``; the root is the least node.

    Each round is written to the shared folder. Nodes with many neighbours meet them in
    partial aggregates and in joins that Spark can split; the number of rounds grows with
    the logarithm of the longest path.
    """
    edges = stage(edges.filter("a <> b").select("a", "b"), "edges")
    state: tuple | None = None
    while True:
        edges = stage(_small_star(_large_star(edges)).distinct(), "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
