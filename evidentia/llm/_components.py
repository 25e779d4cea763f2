"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import materialise

#: The steps need about the logarithm of the longest path; this only ends a faulty loop.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b) with a != b: root is the smallest node reachable.

    Each round is one job. Minima are aggregated before they are joined back, so a node with very
    many neighbours is a skewed join, which Spark can split, and never one large group.
    Roots themselves are not in the result; a node that isn't listed is its own root.
    """
    before = None
    edges, seen = materialise(edges.select("a", "b").where("a <> b").distinct())
    if not seen["rows"]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(nearest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        edges, seen = materialise(now, check=F.bit_xor(F.xxhash64("a", "b")))
        state = (seen["rows"], seen["check"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components aren't complete after {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
