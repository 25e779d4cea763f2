"""Deduplication by keys: representatives, occurrences and exact sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def representatives(rows: DataFrame, key: str, order: Sequence[str], **more: Column) -> DataFrame:
    """One row per key: the least by the order columns (nulls first), how many there were, and further aggregates."""
    least = F.min(F.struct(*order))
    found = rows.groupBy(key).agg(least.alias("__least"), F.count(F.lit(1)).alias("occurrences"), *[c.alias(k) for k, c in more.items()])
    return found.select(key, *[F.col(f"__least.{c}").alias(c) for c in order], "occurrences", *more)


def occurrences(rows: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """keys, copies, and conflicting: whether rows of one key differ in their payload."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), (F.min(payload) != F.max(payload)).alias("conflicting"))


def exact_source_groups(rows: DataFrame, key: Column, id_column: str) -> DataFrame:
    """Groups of two or more rows with an equal key: source_key, representative (least id), members.

    An equality is answered by one aggregation; pairs are never formed.
    """
    return (
        rows.groupBy(key.alias("source_key"))
        .agg(F.min(id_column).alias("representative"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
    )
