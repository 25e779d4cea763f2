"""Constraint passes: rows that break a rule, not exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_partition(whole: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Keys that aren't in exactly one part, or aren't in the whole: key, in_whole, in_parts."""
    every = whole.select(F.col(key), F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts.values():
        every = every.unionByName(part.select(F.col(key), F.lit(0).alias("w"), F.lit(1).alias("p")))
    counts = every.groupBy(key).agg(F.sum("w").alias("in_whole"), F.sum("p").alias("in_parts"))
    return counts.where("in_whole <> 1 or in_parts <> 1")


def without_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def key_faults(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """key, fault and n (rows of the child): keys that stand in several rows are REPEATED, those that no parent has NO_PARENT.
    Both sides are counted in one aggregation, so rows are neither sorted nor joined."""
    sides = child.select(key, F.lit(1).alias("__child")).unionByName(parent.where(F.col(key).isNotNull()).select(key, F.lit(0).alias("__child")))
    counts = sides.groupBy(key).agg(F.sum("__child").alias("n"), (F.min("__child") == 0).alias("__known")).where("n > 0")
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "REPEATED"), F.when(~F.col("__known"), "NO_PARENT")))
    return counts.select(key, F.explode(faults).alias("fault"), "n")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with their multiplicity) of one side that the other doesn't have, and which side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
