"""The date decision: which dates control a candidate, and whether they lie in its period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_date

# Kinds that may control, in the order of preference of each type of source.
PREFERENCE = {
    "notice": ("NOTICE_PUBLISHED", "NOTICE_ISSUED", "ORIGINAL_PUBLICATION"),
    "unknown": ("ORIGINAL_PUBLICATION", "NOTICE_PUBLISHED", "NOTICE_ISSUED"),
    "other": ("ORIGINAL_PUBLICATION",),
}


def preference(source_type: Column, kind: Column) -> Column:
    """Rank of a date kind for a source type (0 first); null for kinds that never control it."""
    found = F.lit(None).cast("int")
    for name, kinds in PREFERENCE.items():
        for rank, k in enumerate(kinds):
            found = F.when((source_type == name) & (kind == k), F.lit(rank)).otherwise(found)
    return found


def decide(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """One decision per candidate: candidate_id, date_valid, diagnostic, controlling_date.

    candidates: candidate_id, source_type, period_start, period_end, and discovered (raw date or null).
    facts: candidate_id, raw, kind. Facts of the most preferred kind control, all ties of them. Missing
    facts, unreadable dates, different dates and dates outside the period have diagnostics of their own.
    """
    stated = facts.groupBy("candidate_id").agg(F.collect_list(F.struct("raw", "kind")).alias("facts"))
    rows = candidates.join(stated, "candidate_id", "left")
    usable = F.filter(F.coalesce("facts", F.array()), lambda f: F.coalesce(F.trim(f["raw"]) != "", F.lit(False)) & preference(F.col("source_type"), f["kind"]).isNotNull())
    rows = rows.withColumn("usable", usable)
    rank = F.array_min(F.transform("usable", lambda f: preference(F.col("source_type"), f["kind"])))
    rows = rows.withColumn("rank", rank)
    control = F.filter("usable", lambda f: preference(F.col("source_type"), f["kind"]) == F.col("rank"))
    dates = F.array_distinct(F.transform(control, lambda f: calendar_date(f["raw"])))
    rows = rows.withColumn("dates", F.coalesce(dates, F.array().cast("array<date>")))
    only = F.when(F.size("dates") == 1, F.col("dates")[0])
    diagnostic = (
        F.when(F.coalesce(F.size("facts"), F.lit(0)) <= 0, F.when(F.col("discovered").isNotNull(), "DATE_PROVENANCE_INVALID").otherwise("DATE_MISSING"))
        .when(F.size("usable") == 0, "DATE_PROVENANCE_INVALID")
        .when(F.exists("dates", lambda d: d.isNull()), "DATE_UNPARSEABLE")
        .when(F.size("dates") > 1, "DATE_CONFLICT")
        .when(~only.between(F.col("period_start"), F.col("period_end")), "OUT_OF_RANGE")
        .otherwise("NONE")
    )
    return rows.select("candidate_id", (diagnostic == "NONE").alias("date_valid"), diagnostic.alias("diagnostic"), only.alias("controlling_date"))


def canonical_member(members: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first member of each group in the given order."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return members.withColumn("__first", first).where("__first = 1").drop("__first")
