"""Checks of recorded proposals, as ordered conditions on columns. The first that is violated names the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LOW_VALUE = ("AWARD_OR_RANKING", "VISIT_INSPECTION_OR_STATEMENT", "FEATURE_OR_BACKGROUND")
GATES = (
    "URL_VALIDATION", "LINK_RESOLUTION", "FETCH_TRANSPORT", "HTTP_STATUS", "CONTENT_TYPE", "SOURCE_PROVENANCE",
    "PRINCIPAL_DOCUMENT", "BODY_AVAILABILITY", "FACTUAL_SUBSTANCE", "SEMANTIC_MATCH", "CATALOGUE_RECORD",
)


def first_violation(**conditions: Column) -> Column:
    """Name of the first condition that isn't true, else null; null counts as not true."""
    found = F.lit(None).cast("string")
    for name, good in reversed(conditions.items()):
        found = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(found)
    return found


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def category(rows: DataFrame) -> DataFrame:
    """rows: event_id, state, category_id, reason, subtype, cited (array)."""
    assigned = F.col("state") == "ASSIGNED"
    return rows.withColumn("violation", first_violation(
        STATE=F.col("state").isin("ASSIGNED", "UNRESOLVED"),
        SHAPE=(assigned & F.col("category_id").isNotNull() & F.col("reason").isNull()) | (~assigned & F.col("category_id").isNull() & F.col("reason").isNotNull()),
        SUBTYPE=~assigned | F.regexp_like("subtype", F.lit("^[a-z][a-z0-9_]{0,63}$")),
        CITATION=F.size("cited") > 0,
    ))


def taxonomy(rows: DataFrame) -> DataFrame:
    """rows: event_id, assigned, supported, conflicting, named, members (arrays), insufficient."""
    return rows.withColumn("violation", first_violation(
        SUPPORT=same_set(F.col("assigned"), F.col("supported")),
        CONFLICT=(F.size("conflicting") == 0) | (F.size(F.array_distinct("conflicting")) >= 2),
        INSUFFICIENT=~F.col("insufficient") | same_set(F.col("named"), F.col("members")),
    ))


def reportability(rows: DataFrame) -> DataFrame:
    """rows: event_id, examined, members (arrays), occurrence, proposed. A low-value occurrence overrides what is proposed."""
    state = F.when(F.col("occurrence").isin(*LOW_VALUE), "NOT_REPORTABLE").otherwise(F.col("proposed"))
    return rows.withColumn("violation", first_violation(
        MEMBERS=same_set(F.col("examined"), F.col("members")), PROPOSED=F.col("proposed").isin("REPORTABLE", "NOT_REPORTABLE"),
    )).withColumn("state", F.when(F.col("violation").isNull(), state))


def gate_order(gate: Column) -> Column:
    """1-based place of a gate; 0 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(g) for g in GATES]), gate), F.lit(0)), F.lit(0)).cast("int")


def eligible(region: Column, allowed: Column, conflict: Column, monitored: Column) -> Column:
    """Typed reason why an event's region keeps it out of the report, else null."""
    return F.when(monitored, None).when(conflict, "REGION_CONFLICT").when(region.isNull(), "REGION_NOT_ESTABLISHED").when(~allowed, "REGION_NOT_DESIGNATED")
