"""Connected components by alternating stars over distinct edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relaylens.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(
        F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are tied to the smallest of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    own = least.select(F.col("m").alias("a"), "b")
    rest = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.unionByName(rest).filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a < b); the root is the smallest node reached.

    The number of rounds grows with the logarithm of the nodes; every round is a table in the
    shared folder, so that lineage stays short and a lost executor costs one round at most.
    """
    now, mark = written(edges.select("a", "b"), "edges"), None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b"))
                       .alias("x")).first()
        if seen["n"] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        now = written(_small(_large(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
