"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeflow.session import materialize

MOST_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the component's smallest node.

    Every star is a minimum per node, which combines before the shuffle, and a join with that
    minimum, which adaptive execution can split. Each round is written to the shared folder; the driver sees
    a count and a sum of hashes. Self-loops and nulls are left out.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.least("m", "n").alias("b")).distinct()
        smallest = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        pulled = large.join(smallest, F.col("a") == F.col("n")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(pulled.unionByName(smallest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
