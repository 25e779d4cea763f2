"""From reportable events to a report: metadata of events, written blocks, assembly, and the texts around it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

# Sections in their order.
SECTIONS = ("TECHNICAL_DEVELOPMENT", "INCIDENT", "OPERATIONAL_CHANGE", "PROCUREMENT", "NORMATIVE_CHANGE")
#: How a region came to be established.
ESTABLISHED = ("SOURCE_STATED", "REFERENCE_MAPPED")


def evidence_of(candidates: DataFrame, evidence: DataFrame, scope: DataFrame, temporal: DataFrame) -> DataFrame:
    """Candidates with ready evidence, in scope and dated in the period, with the columns of all four."""
    ready = candidates.join(evidence.where("state = 'READY'"), "candidate_id")
    return ready.join(scope.where("scope = 'IN_SCOPE'"), "candidate_id").join(temporal.where("date_valid"), "candidate_id")


def agreed_value(rows: DataFrame, field: str) -> DataFrame:
    """event_id, value, diagnostic: the one value that the members state, else the canonical member's, else null."""
    seen = rows.groupBy("event_id").agg(F.count_distinct(field).alias("n"), F.min(field).alias("one"), F.max(F.when(F.col("canonical"), F.col(field))).alias("own"))
    value = F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("own"))
    return seen.select("event_id", value.alias("value"), F.when(F.col("n") == 0, "NOT_STATED").when(F.col("n") == 1, "NONE").when(F.col("own").isNotNull(), "CANONICAL_MEMBER").otherwise("CONFLICT").alias("diagnostic"))


def formal_metadata(members: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, exclusions) of events. members: event_id, canonical, region_id, basis, location, system, monitored.

    Members' established regions must agree on one that is allowed (allowed: region_id), unless the event is a
    monitored update. Metadata: event_id, region_id, region_basis, location, system. Exclusions: event_id, reason.
    """
    stated = F.when(F.col("basis").isin(*ESTABLISHED), F.col("region_id"))
    region = members.groupBy("event_id").agg(
        F.count_distinct(stated).alias("n"), F.min(stated).alias("region_id"), F.bool_or(F.coalesce((F.col("basis") == "SOURCE_STATED") & stated.isNotNull(), F.lit(False))).alias("said"),
        F.bool_and("monitored").alias("monitored"), F.count_distinct("location").alias("places"), F.min("location").alias("location"),
    )
    system = agreed_value(members, "system").select("event_id", F.col("value").alias("system"))
    listed = allowed.select("region_id", F.lit(True).alias("allowed")).distinct()
    met = region.join(listed, "region_id", "left").join(system, "event_id")
    reason = F.when(F.col("monitored"), None).when(F.col("n") > 1, "REGION_CONFLICT").when(F.col("n") == 0, "REGION_NOT_ESTABLISHED").when(F.col("allowed").isNull(), "REGION_NOT_DESIGNATED")
    met = met.withColumn("reason", reason)
    kept = met.where("reason is null").select(
        "event_id", F.when(F.col("n") == 1, F.col("region_id")).alias("region_id"), F.when(F.col("n") == 1, F.when(F.col("said"), "SOURCE_STATED").otherwise("REFERENCE_MAPPED")).alias("region_basis"),
        F.when(F.col("places") == 1, F.col("location")).alias("location"), "system",
    )
    return kept, met.where("reason is not null").select("event_id", "reason")


def written_blocks(events: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their block, gaps): the last recorded block of each event; events without one are gaps of the stage Writer.
    blocks: event_id, attempt, headline, prose."""
    last = blocks.groupBy("event_id").agg(F.max_by(F.struct("headline", "prose"), "attempt").alias("b"))
    return events.join(last, "event_id").select(*events.columns, "b.*"), events.join(last, "event_id", "left_anti").select(F.lit("Writer").alias("stage"), F.col("event_id").alias("subject_id"))


def validated(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """event_id, attempt, valid of each event's deciding block: the first without findings, of the two that there may be.
    blocks: event_id, attempt; findings: event_id, attempt."""
    bad = findings.select("event_id", "attempt").distinct().withColumn("__bad", F.lit(True))
    rows = blocks.where("attempt <= 2").join(bad, ["event_id", "attempt"], "left")
    return rows.groupBy("event_id").agg(
        F.coalesce(F.min(F.when(F.col("__bad").isNull(), F.col("attempt"))), F.max("attempt")).alias("attempt"), F.bool_or(F.col("__bad").isNull()).alias("valid")
    )


def assembled(events: DataFrame, report: str) -> DataFrame:
    """One row for each report: report id (a hash of its events in order) and its text, sections in their order.
    events: the column named by report, section, position, event_id, headline, prose, source, url."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    entry = F.concat(F.lit("### "), "headline", F.lit("\n\n"), "prose", F.lit("\n\n["), text.escape_link(F.col("source")), F.lit("]("), "url", F.lit(")"))
    shown = events.withColumn("__first", F.row_number().over(Window.partitionBy(report, "section").orderBy("position", "event_id")) == 1)
    line = F.when(F.col("__first"), F.concat(F.lit("## "), "section", F.lit("\n\n"), entry)).otherwise(entry)
    rows = shown.groupBy(report).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "position", "event_id", line.alias("line")))).alias("rows"))
    listed = F.transform("rows", lambda r: r["event_id"])
    return rows.select(report, ids.content_id("", 16, events=listed).alias("report_id"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("text"))


def disclosure(counts: Mapping[str, Column]) -> Column:
    """The counters that aren't zero, as one sentence each."""
    lines = F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}."))) for name, n in counts.items()])
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), " ")


def summary_line(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """key=value pairs of each group in the order of the keys."""
    pairs = F.array_sort(F.collect_list(F.struct(key, value)))
    return rows.groupBy(group).agg(F.array_join(F.transform(pairs, lambda p: F.concat(p[key], F.lit("="), p[value].cast("string"))), " ").alias("summary"))


def probes(rows: DataFrame, batch: str, order: str, places: tuple[int, ...] = (1, 10, 60, 65, 115, 122)) -> DataFrame:
    """Rows at fixed places of each batch, for a health check."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(order))).where(F.col("place").isin(*places))


# Counts of a summary, by the stage that gives them.
SUMMARY = {
    "planned": "search_plan", "attempted": "search_attempts", "unattempted": "search_unattempted", "in_scope": "temporal_results",
    "records": "event_identity_records", "categorized": "category_results", "reportable": "ordered_results", "formal_metadata": "formal_metadata",
    "metadata_exclusions": "metadata_exclusions", "generated": "writer_blocks", "validated": "validation_passed", "validation_failed": "validation_failed",
    "final_report_events": "final_report_events",
}


def engineering_summary(counts: DataFrame, reasons: DataFrame, most: int = 5) -> DataFrame:
    """One row for each run: its stages' counts, failures of the search, and the most frequent reasons of rejection.

    counts: run_id, stage, n; a stage that a run didn't reach has no row, and its count is null. reasons:
    run_id, kind (search_failure, evidence_reason, evidence_gate), reason, n; rows that repeat are added up.
    What was discovered and the number of events include the technical gaps of their stage.
    Reasons read "reason=n", joined by "; ", by falling n and then by reason.
    """
    n_of = lambda stage: F.sum(F.when(F.col("stage") == stage, F.col("n")))
    or_zero = lambda c: F.coalesce(c, F.lit(0))
    row = counts.groupBy("run_id").agg(
        *[n_of(stage).alias(name) for name, stage in SUMMARY.items()],
        (n_of("evidence_results") + or_zero(n_of("technical_gaps_evidence"))).alias("discovered"),
        (n_of("category_results") + or_zero(n_of("technical_gaps_category"))).alias("events"),
        or_zero(n_of("technical_gaps")).alias("technical_gaps"),
    )
    summed = reasons.groupBy("run_id", "kind", "reason").agg(F.sum("n").alias("n"))
    failed = summed.where("kind = 'search_failure'").groupBy("run_id").agg(F.sum("n").alias("failed"))
    place = F.row_number().over(Window.partitionBy("run_id", "kind").orderBy(F.col("n").desc(), "reason"))
    ranked = summed.where("kind in ('evidence_reason', 'evidence_gate')").withColumn("place", place).where(F.col("place") <= most)
    shown = F.struct("place", F.concat("reason", F.lit("="), F.col("n").cast("string")).alias("shown"))
    listed = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, shown)))["shown"], "; ")
    top = ranked.groupBy("run_id").agg(listed("evidence_reason").alias("reasons"), listed("evidence_gate").alias("gates"))
    found = row.join(failed, "run_id", "left").join(top, "run_id", "left")
    return found.select(
        *row.columns, or_zero(F.col("failed")).alias("technical_failures"), (or_zero(F.col("failed")) > 0).alias("degraded"),
        F.coalesce("reasons", F.lit("")).alias("top_evidence_reasons"), F.coalesce("gates", F.lit("")).alias("top_evidence_gates"),
    )
