"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import materialise, quoted, small

#: Characters of a text that the second level hashes.
PREFIX = 64


def exact_duplicates(docs: DataFrame, **carry: Column) -> DataFrame:
    """Groups of rows with byte-identical text; the row with the largest doc_id of each group stays.

    Three levels: rows that share their length with another row go on, of these those that also share
    a hash of the first characters, and only for these the whole text is hashed (SHA-256). The first two
    levels are counts of one narrow table, taken in one pass over the texts; a second pass hashes what is
    left. Counts are aggregated before they are shuffled; texts never move. The keys of the second level
    reach the second pass as a broadcast while they are few (counted first), else by a join.

    docs needs doc_id (long) and text; null text counts as empty. carry names expressions over docs
    that are returned too. Other columns are ignored. Rows that repeat an id with equal text are one
    group, in which one row stays; null ids are smaller than all others, and a group of null ids only
    keeps one row of them with keep_id null. An empty table gives no rows.
    Returns one row per row of docs: doc_id, keep_id, group_size, kept, and what carry names.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [quoted(c) for c in carry]
    profile = docs.select(
        F.col("doc_id").cast("long").alias("__id"), body.alias("__text"), F.octet_length(body).alias("__length"),
        F.xxhash64(F.substring(body, 1, PREFIX)).alias("__prefix"), *[c.alias(k) for k, c in carry.items()],
    )
    counted, _ = materialise(profile.groupBy("__length", "__prefix").agg(F.count(F.lit(1)).alias("n")))
    lengths = counted.groupBy("__length").agg(F.sum("n").alias("n")).where("n > 1").select("__length")
    second = counted.join(lengths, "__length", "left_semi").where("n > 1").select("__length", "__prefix", F.lit(True).alias("__again"))
    shared, seen = materialise(second)
    # the whole text is hashed only where both levels are shared
    rows = profile.join(small(shared, seen["rows"]), ["__length", "__prefix"], "left")
    rows = rows.withColumn("__full", F.when(F.col("__again"), F.sha2(F.col("__text").cast("binary"), 256))).drop("__text", "__again")
    alone = rows.where("__full is null").select(F.col("__id").alias("doc_id"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *kept)
    met = rows.where("__full is not null")
    met, _ = materialise(met.withColumn("__row", F.monotonically_increasing_id()))
    key = ["__length", "__prefix", "__full"]
    # in a group of null ids only, any one row stays
    groups = met.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), F.max("__id").alias("__keep"), F.max_by("__row", "__id").alias("__best"), F.max("__row").alias("__any"))
    groups, found = materialise(groups)
    done = met.join(small(groups, found["rows"], 120), key).select(
        F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), "group_size", (F.col("__row") == F.coalesce("__best", "__any")).alias("kept"), *kept
    )
    return alone.unionByName(done)
