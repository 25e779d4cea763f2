"""Checks of recorded proposals and prose, the first violation in a fixed order, and what the accepted ones come to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt
from .proposals import LOW_VALUE, first_violation

# Systems in their order, and assessments that a field may rest on.
SYSTEMS = ("ROLLING_STOCK", "SIGNALLING", "POWER_SUPPLY", "COMMUNICATIONS", "AUTOMATIC_FARE_COLLECTION", "DEPOT_MAINTENANCE_EQUIPMENT", "PLATFORM_SCREEN_DOORS")
SCOPES = ("IN_SCOPE", "OUT_OF_SCOPE")
SCOPE_DIAGNOSTICS = ("NONE", "EXCLUDED_TRANSPORT_MODE", "NON_URBAN_RAIL", "SCOPE_NOT_ESTABLISHED")
ASSESSMENTS = ("SUPPORTED", "NEUTRAL")


def inside_focus(cited: Column, focus: Column) -> Column:
    """Whether all cited spans lie between the first start and the last end of the focus (arrays of start, end)."""
    first, last = F.array_min(F.transform(focus, lambda f: f["start"])), F.array_max(F.transform(focus, lambda f: f["end"]))
    return F.coalesce(F.forall(cited, lambda s: (s["start"] >= first) & (s["end"] <= last)), F.lit(False))


def anchored(relation: Column, focus: Column, endpoints: Column) -> Column:
    """Whether the relation names one of the endpoints and the focus all of them, in any case."""
    low = lambda c: F.lower(c)
    return (F.size(endpoints) > 0) & F.exists(endpoints, lambda e: F.contains(low(relation), low(e))) & F.forall(endpoints, lambda e: F.contains(low(focus), low(e)))


def scope(rows: DataFrame) -> DataFrame:
    """rows with violation and scope: state, diagnostic, confidence, cited and focus (arrays of start, end), relation,
    focus_text, endpoints (array). A proposal that breaks a rule leaves the scope unestablished."""
    inside = F.col("state") == "IN_SCOPE"
    violation = first_violation(
        STATE=F.col("state").isin(*SCOPES),
        DIAGNOSTIC=F.col("diagnostic").isin(*SCOPE_DIAGNOSTICS),
        STATE_DIAGNOSTIC=inside == (F.col("diagnostic") == "NONE"),
        CONFIDENCE=F.col("confidence").between(0, 1),
        CITATION=F.size("cited") > 0,
        DUPLICATE_CITATION=F.size(F.array_distinct("cited")) == F.size("cited"),
        FOCUS=~inside | (F.size("focus") > 0),
        OUTSIDE_FOCUS=~inside | inside_focus(F.col("cited"), F.col("focus")),
        ENDPOINTS=~inside | anchored(F.col("relation"), F.col("focus_text"), F.col("endpoints")),
    )
    found = rows.withColumn("violation", violation)
    return found.withColumn("scope", F.when(F.col("violation").isNull(), F.col("state")).otherwise("SCOPE_NOT_ESTABLISHED"))


def monitored_change(rows: DataFrame, cited: DataFrame) -> DataFrame:
    """rows with violation: the identifier must be one of those supplied, the action legal, and the cited text must name it.
    rows: candidate_id, identifier, supplied (array), action; cited: candidate_id, valid, cited (see segments.cited)."""
    met = rows.join(cited.select("candidate_id", "valid", "cited"), "candidate_id", "left")
    return met.withColumn("violation", first_violation(
        IDENTIFIER=F.array_contains("supplied", F.col("identifier")), ACTION=F.col("action").isin("PUBLISHED", "AMENDED", "WITHDRAWN", "PROPOSED"),
        CITATION=F.col("valid"), NOT_NAMED=F.contains(F.lower("cited"), F.lower("identifier")),
    )).drop("valid", "cited")


def metadata(observed: DataFrame) -> DataFrame:
    """One row for each candidate and field: value, diagnostic. The first failure by position decides, then two different
    values are a CONFLICT. observed: candidate_id, field, position, value, failure."""
    found = observed.groupBy("candidate_id", "field").agg(
        F.min(F.when(F.col("failure").isNotNull(), F.struct("position", "failure"))).alias("failed"), F.count_distinct("value").alias("values"), F.min("value").alias("value")
    )
    one = F.col("failed").isNull() & (F.col("values") == 1)
    return found.select("candidate_id", "field", F.when(one, F.col("value")).alias("value"), F.coalesce("failed.failure", F.when(F.col("values") > 1, "CONFLICT").when(F.col("values") == 0, "NOT_STATED").otherwise("NONE")).alias("diagnostic"))


def judgement(rows: DataFrame) -> DataFrame:
    """rows with violation: relation must be known, and SAME_EVENT needs a supporting span of each side."""
    same = F.col("relation") == "SAME_EVENT"
    return rows.withColumn("violation", first_violation(
        RELATION=F.col("relation").isin("SAME_EVENT", "DISTINCT_EVENT", "UNCERTAIN"), SUPPORT=~same | ((F.size("left_spans") > 0) & (F.size("right_spans") > 0)), CONFIDENCE=F.col("confidence").between(0, 1),
    ))


def boundaries(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Violations of written events: one canonical member, its url and source, and prose that isn't blank.
    rows: event_id, canonical_id, url, headline, prose; members: event_id, candidate_id, url, canonical (boolean)."""
    sole = members.where("canonical").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("member"), F.min("url").alias("member_url"))
    met = rows.join(sole, "event_id", "left")
    return met.withColumn("violation", first_violation(
        EVENT_ID=F.trim("event_id") != "", HEADLINE=F.trim("headline") != "", PROSE=F.trim("prose") != "", CANONICAL=F.col("n") == 1,
        CANONICAL_ID=F.col("canonical_id") == F.col("member"), URL=F.col("url") == F.col("member_url"),
    )).drop("n", "member", "member_url")


#: What may be wrong with an assessment, worst first.
STRUCTURE = ("MISSING_UNIT", "EXTRA_UNIT", "REPEATED_UNIT", "CITATION")


def structure(assessed: DataFrame, units: DataFrame, known: DataFrame, count: int | None = None) -> DataFrame:
    """event_id and violation of an assessment: it must have each unit of its event once, no others, and cite known
    references only. assessed: event_id, unit_id, reference (or null); units: event_id, unit_id; known: event_id, reference.
    Units and known references may repeat; null ids equal nothing. count: rows of all sides, or more, if that is known.

    All sides meet as one table, dealt before it is summed up, so a task neither sorts nor holds more rows as the tables
    grow. An event's rows are dealt by unit and reference; by event only the place of their fault goes on.
    """
    side = lambda df, key, what: df.select("event_id", F.col(key).alias("id"), F.lit(what).cast("tinyint").alias("what"))
    said, given, cites, knows = range(4)
    rows = side(assessed, "unit_id", said).unionByName(side(units, "unit_id", given))
    rows = rows.unionByName(side(assessed.where("reference is not null"), "reference", cites)).unionByName(side(known, "reference", knows))
    count = rows.count() if count is None else count
    unit, apart = F.col("what") < cites, F.col("event_id").isNull() | F.col("id").isNull()
    ids = ("event_id", "id", unit.alias("is_unit"))
    met = dealt(rows, count, "event_id", "id").groupBy(*ids).agg(F.count_if(F.col("what").isin(said, cites)).alias("said"), F.count_if(F.col("what").isin(given, knows)).alias("given"))
    says, has = F.col("said") > 0, F.col("given") > 0
    place = (
        F.when(~F.col("is_unit"), F.when(says & (~has | apart), 4))
        .when(has & (~says | apart), 1).when(says & (~has | apart), 2).when(F.col("said") > 1, 3).otherwise(len(STRUCTURE) + 1)
    )
    worst = dealt(met.select("event_id", place.alias("place")).where("place is not null"), count, "event_id").groupBy("event_id").agg(F.min("place").alias("place"))
    return worst.select("event_id", F.get(F.array(*[F.lit(v) for v in STRUCTURE]), F.col("place") - 1).alias("violation"))


def assessed_fields(rows: DataFrame) -> DataFrame:
    """rows that don't hold: their assessment isn't allowed for their field; an insight may be ANALYSIS too. rows: field, assessment."""
    fine = F.col("assessment").isin(*ASSESSMENTS) | ((F.col("field") == "insight") & (F.col("assessment") == "ANALYSIS"))
    return rows.where(~F.coalesce(fine, F.lit(False)))


def corrections(rows: DataFrame, group: str, order: str, message: str) -> DataFrame:
    """The distinct messages of each group in the order in which they came first, one a line."""
    first = rows.groupBy(group, message).agg(F.min(order).alias("__at"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", message))), lambda m: m[message]), "\n").alias("feedback"))


def canonical_systems(systems: Column) -> Column:
    """Known systems in their fixed order; null if one is listed twice or isn't known."""
    known = F.array(*[F.lit(s) for s in SYSTEMS])
    good = (F.size(F.array_distinct(systems)) == F.size(systems)) & (F.size(F.array_except(systems, known)) == 0)
    return F.when(good, F.filter(known, lambda s: F.array_contains(systems, s)))


def ordered_spans(rows: DataFrame, group: str) -> DataFrame:
    """group and its spans by (place of the system, candidate, start, end). rows: group, system, candidate_id, start, end."""
    place = F.array_position(F.array(*[F.lit(s) for s in SYSTEMS]), F.col("system")).alias("place")
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(place, "candidate_id", "start", "end"))).alias("spans"))


def restricted(rows: DataFrame) -> DataFrame:
    """event_id and violation: an event is all monitored or not at all, and monitored events are NORMATIVE_CHANGE.
    rows: event_id, candidate_id, standard (null if it isn't monitored), category."""
    seen = rows.groupBy("event_id").agg(F.bool_or(F.col("standard").isNotNull()).alias("some"), F.bool_and(F.col("standard").isNotNull()).alias("all"), F.min("category").alias("category"))
    return seen.select("event_id", first_violation(MIXED=F.col("some") == F.col("all"), CATEGORY=~F.col("some") | (F.col("category") == "NORMATIVE_CHANGE")).alias("violation"))


def standard_of(rows: DataFrame) -> DataFrame:
    """event_id and the standard of its canonical member, else the least by list_order of the others."""
    return rows.groupBy("event_id").agg(F.coalesce(F.max(F.when(F.col("canonical"), F.col("standard"))), F.min_by("standard", F.when(F.col("standard").isNotNull(), F.col("list_order")))).alias("standard"))


def earliest_failure(stages: Mapping[str, Column]) -> Column:
    """Name of the first stage that isn't as expected, else NONE."""
    out = F.lit("NONE")
    for name, good in reversed(stages.items()):
        out = F.when(~F.coalesce(good, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def evaluation(rows: DataFrame, failure: str) -> DataFrame:
    """Number of rows for each earliest failure."""
    return rows.groupBy(failure).agg(F.count(F.lit(1)).alias("n"))


def stable(rows: DataFrame, slot: str, round_: str, outcome: str, rounds: int) -> DataFrame:
    """slot, rounds it took part in, outcomes, and stable: whether it had the same outcome in all rounds."""
    seen = rows.groupBy(slot).agg(F.count_distinct(round_).alias("rounds"), F.count_distinct(outcome).alias("outcomes"))
    return seen.withColumn("stable", (F.col("rounds") == rounds) & (F.col("outcomes") == 1))


def digest_state(recorded: Column, content: Column) -> Column:
    """MATCH, MISMATCH or MISSING of a recorded SHA-256 against the content."""
    return F.when(recorded.isNull() | content.isNull(), "MISSING").when(recorded == F.sha2(content, 256), "MATCH").otherwise("MISMATCH")


def reportable(rows: DataFrame) -> DataFrame:
    """rows with gate: reportability is only asked for events with a category and an accepted taxonomy; rows: category_state,
    taxonomy_state, occurrence, proposed. A low-value occurrence is never reportable."""
    ready = (F.col("category_state") == "ASSIGNED") & (F.col("taxonomy_state") == "EVALUATED")
    state = F.when(F.col("occurrence").isin(*LOW_VALUE), "NOT_REPORTABLE").otherwise(F.col("proposed"))
    return rows.withColumn("gate", F.when(F.coalesce(ready, F.lit(False)), state).otherwise("NOT_REACHED"))




def citation_spans(citations: DataFrame, references: DataFrame, sentences: DataFrame) -> DataFrame:
    """subject_id, valid, reason and spans (candidate_id, start, end; each once, in the order they are cited first).

    citations: subject_id, ordinal, source_ref, sentence_id (one row for each sentence cited, ordinal total within the subject);
    references: subject_id, source_ref, candidate_id; sentences: candidate_id, sentence_id, start, end. A citation
    whose source or sentence is unknown makes its subject invalid; a subject without citations isn't listed.
    """
    named = citations.join(references, ["subject_id", "source_ref"], "left").join(sentences, ["candidate_id", "sentence_id"], "left")
    fault = F.when(F.col("candidate_id").isNull(), "UNKNOWN_SOURCE").when(F.col("start").isNull(), "UNRESOLVED_SENTENCE")
    once = named.groupBy("subject_id", "candidate_id", "start", "end").agg(F.min("ordinal").alias("ordinal"), F.min(F.when(fault.isNotNull(), F.struct("ordinal", fault.alias("reason")))).alias("fault"))
    span = F.when(F.col("fault").isNull(), F.struct("ordinal", "candidate_id", "start", "end"))
    found = once.groupBy("subject_id").agg(F.min("fault").alias("fault"), F.array_sort(F.collect_list(span)).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["candidate_id"].alias("candidate_id"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("subject_id", F.col("fault").isNull().alias("valid"), F.col("fault.reason").alias("reason"), F.when(F.col("fault").isNull(), spans).alias("spans"))


def aligned(groups: DataFrame, members: DataFrame, categories: DataFrame, key: str = "event_id") -> DataFrame:
    """One row for each key of three results that belong together, and fault where one of them lacks it or has it twice:
    results are matched by key, never by their position. Columns other than key must differ between the three."""
    counted = None
    for name, df in (("groups", groups), ("members", members), ("categories", categories)):
        one = df.select(key, F.lit(name).alias("side"))
        counted = one if counted is None else counted.unionByName(one)
    sides = counted.groupBy(key).agg(F.collect_set("side").alias("sides"), F.count(F.lit(1)).alias("n"))
    fault = F.when(F.size("sides") < 3, "MISSING").when(F.col("n") > 3, "REPEATED")
    whole = sides.select(key, fault.alias("fault"))
    good = whole.where("fault is null").join(groups, key).join(members, key).join(categories, key)
    return good.unionByName(whole.where("fault is not null"), allowMissingColumns=True)
