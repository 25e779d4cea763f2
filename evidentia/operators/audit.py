"""Audit of a run: where every candidate and event ended, what stages counted, and rules that hold across tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Stages of the audit in their order.
STAGES = ("EVIDENCE", "SCOPE", "TEMPORAL", "EVENT_IDENTITY", "CATEGORY", "TAXONOMY", "REPORTABILITY", "ORDERING", "METADATA", "WRITER", "VALIDATOR", "FINAL_REPORT")
#: Where events without a position stand.
NOWHERE = 1_000_000


def outcomes(groups: DataFrame, **stages: DataFrame) -> DataFrame:
    """event_id, stage, reason: the first stage, in the order given, that has the event (event_id, reason); else FINAL_REPORT."""
    rows, steps = groups.select("event_id"), []
    for name, found in stages.items():
        rows = rows.join(found.select("event_id", F.struct(F.lit(name.upper()).alias("stage"), "reason").alias(f"__{name}")), "event_id", "left")
        steps.append(F.col(f"__{name}"))
    end = F.coalesce(*steps, F.struct(F.lit("FINAL_REPORT").alias("stage"), F.lit("INCLUDED").alias("reason")))
    return rows.select("event_id", end.alias("__e")).select("event_id", "__e.stage", "__e.reason")


def stage_place(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def audit_order(rows: DataFrame) -> DataFrame:
    """rows with the keys they are sorted by: the later the stage the earlier, then by id backwards; events by their position."""
    return rows.withColumn("stage_key", -stage_place(F.col("stage"))).withColumn("position_key", F.coalesce("position", F.lit(NOWHERE)))


def pair_diagnostics(pairs: DataFrame) -> DataFrame:
    """candidate_id, reason, n: how often a candidate is part of a pair with a diagnostic, from both ends."""
    ends = pairs.select(F.col("left_id").alias("candidate_id"), "reason").unionByName(pairs.select(F.col("right_id").alias("candidate_id"), "reason"))
    return ends.groupBy("candidate_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def rejected_members(details: Column) -> Column:
    """sorted array<struct<member, reason>> of entries like "member:reason"; members may hold colons."""
    return F.array_sort(F.transform(details, lambda x: F.struct(F.regexp_extract(x, r"^(.*):[^:]*$", 1).alias("member"), F.substring_index(x, ":", -1).alias("reason"))))


def gap_signature(stage: Column, kind: Column, detail: Column) -> Column:
    """stage:kind:detail, with a detail that is no plain token as UNKNOWN."""
    return F.concat_ws(":", stage, kind, text.safe_token(detail))


def gap_histogram(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy(gap_signature(F.col("stage"), F.col("kind"), F.col("detail")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def stage_facts(rows: DataFrame, stage: str, fact: str, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """stage, fact, n; facts outside their stage's vocabulary count as UNKNOWN."""
    known = F.lit(False)
    for name, words in vocabulary.items():
        known = F.when(F.col(stage) == name, F.col(fact).isin(*words)).otherwise(known)
    return rows.select(stage, F.when(F.coalesce(known, F.lit(False)), F.col(fact)).otherwise("UNKNOWN").alias(fact)).groupBy(stage, fact).agg(F.count(F.lit(1)).alias("n"))


def field_state(value: Column, reached: Column, from_: int) -> Column:
    """value; NOT_REACHED where the gate that was reached comes before from_ and there is none; else null."""
    return F.coalesce(value, F.when(reached < from_, "NOT_REACHED"))


def evidence_projection(content: Column, excerpt: int) -> Column:
    """What an audit shows of a content: its hash, its length, and the start of it."""
    return F.struct(F.sha2(content, 256).alias("sha256"), F.length(content).alias("chars"), text.clip(content, excerpt).alias("excerpt"))


def bounded(rows: DataFrame, column: str, most: int) -> DataFrame:
    """One row: whether no value is longer than most."""
    return rows.agg(F.bool_and(F.length(column) <= most).alias("bounded"))


def repeated_gaps(gaps: DataFrame) -> DataFrame:
    """(stage, subject_id) with more than one gap; gaps of EventIdentity are told apart by their kind too."""
    key = F.when(F.col("stage") == "EventIdentity", F.col("kind"))
    return gaps.groupBy("stage", "subject_id", key.alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stage", "subject_id")


def uncovered(inputs: DataFrame, results: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """Inputs that have neither a result nor a gap, and results without an input: key, fault."""
    done = results.select(key).unionByName(gaps.select(F.col("subject_id").alias(key))).distinct()
    lost = inputs.select(key).join(done, key, "left_anti").withColumn("fault", F.lit("NO_RESULT"))
    return lost.unionByName(results.select(key).join(inputs.select(key), key, "left_anti").withColumn("fault", F.lit("NO_INPUT")))


def broken_rules(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """key and rule for every rule that a row breaks; null counts as broken."""
    listed = F.array(*[F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in rules.items()])
    return rows.select(key, F.explode(F.filter(listed, lambda r: r.isNotNull())).alias("rule"))


def observation_rules() -> dict[str, Column]:
    """Rules of a row of observations: attempted, terminal, failure, results."""
    a, t, f, n = (F.col(c) for c in ("attempted", "terminal", "failure", "results"))
    return {
        "NOT_ATTEMPTED_HAS_NO_RESULT": a | ((n == 0) & f.isNull()), "FAILURE_HAS_REASON": (t != "FAILED") | f.isNotNull(), "SUCCESS_HAS_NO_REASON": (t == "FAILED") | f.isNull(),
        "ZERO_RESULTS": (t != "ZERO_RESULTS") | (n == 0), "RESULTS": (t != "SUCCESS_WITH_RESULTS") | (n > 0),
    }


def evidence_rules() -> dict[str, Column]:
    """Rules of a row of evidence: state, content, reason, value, start, end."""
    ready = F.col("state") == "READY"
    return {
        "READY_HAS_CONTENT": ~ready | (F.trim("content") != ""), "READY_HAS_NO_REASON": ~ready | F.col("reason").isNull(), "REJECTED_HAS_REASON": ready | F.col("reason").isNotNull(),
        "VALUE_IN_SPAN": F.col("value").isNull() | F.contains(F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")), F.col("value")),
    }


def ordering_faults(events: DataFrame, members: DataFrame) -> DataFrame:
    """event_id, fault of events that can't be ordered. events: event_id, canonical_id, members (number), day; members: event_id, candidate_id."""
    counts = members.groupBy("event_id").agg(F.count_distinct("candidate_id").alias("found"), F.collect_set("candidate_id").alias("ids"))
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("times"))
    met = events.join(counts, "event_id", "left").join(twice, "event_id")
    fault = F.when(F.col("times") > 1, "REPEATED_EVENT").when(F.coalesce("found", F.lit(0)) != F.col("members"), "MEMBERS").when(~F.coalesce(F.array_contains("ids", F.col("canonical_id")), F.lit(False)), "CANONICAL").when(F.col("day").isNull(), "DATE")
    return met.select("event_id", fault.alias("fault")).where("fault is not null").distinct()


def owners(publications: DataFrame, families: DataFrame) -> DataFrame:
    """publication, owner: a publication owns itself, and those listed in its family. families: parent, children (array)."""
    own = publications.select("publication", F.col("publication").alias("owner"))
    listed = families.select(F.explode("children").alias("publication"), F.col("parent").alias("owner"))
    return listed.unionByName(own.join(listed.select("publication"), "publication", "left_anti"))


def family_faults(publications: DataFrame, families: DataFrame) -> DataFrame:
    """publication, fault: a parent that isn't listed, a child that is listed itself, a child of two parents."""
    listed = publications.select("publication")
    child = families.select(F.explode("children").alias("publication"), "parent")
    lost = families.select(F.col("parent").alias("publication")).distinct().join(listed, "publication", "left_anti").withColumn("fault", F.lit("PARENT_NOT_LISTED"))
    own = child.select("publication").distinct().join(listed, "publication", "left_semi").withColumn("fault", F.lit("CHILD_LISTED"))
    two = child.groupBy("publication").agg(F.count_distinct("parent").alias("n")).where("n > 1").select("publication", F.lit("TWO_PARENTS").alias("fault"))
    return lost.unionByName(own).unionByName(two)


def owned(identifiers: DataFrame, owner_of: DataFrame) -> DataFrame:
    """identifiers with owner: of the identifier as it stands, else without a year at its end (after a colon or a dash). identifiers: identifier; owner_of: publication, owner."""
    exact = owner_of.select(F.col("publication").alias("identifier"), F.col("owner").alias("__exact"))
    bare = owner_of.select(F.col("publication").alias("__bare"), F.col("owner").alias("__other"))
    rows = identifiers.join(exact, "identifier", "left").withColumn("__bare", F.regexp_replace("identifier", r"[:-]\d{4}$", "")).join(bare, "__bare", "left")
    return rows.withColumn("owner", F.coalesce("__exact", "__other")).drop("__exact", "__bare", "__other")


def identifiers(text_: Column, prefixes: Sequence[str]) -> Column:
    """Distinct identifiers (prefix and number, parts by dashes, and a year) in a text, in their order, none that goes on
    with letters, and no packs of a whole series (SER after the number or year). Full-width letters, digits and marks count as their plain forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    shape = rf"((?:{'|'.join(prefixes)})\s?\d+(?:-\d+)*(?::\d{{4}})?)(?![\w-])(?!\s*(?::\d{{4}})?\s*SER(?![A-Za-z0-9]))"
    found = F.regexp_extract_all(F.translate(text_, wide, plain), F.lit(rf"(?<!\w){shape}"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s", " ")))


def coverage(wanted: DataFrame, configured: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """key, times of what isn't covered exactly once by the configured or the explained."""
    both = configured.select(key).unionByName(explained.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return wanted.select(key).distinct().join(both, key, "full_outer").select(key, F.coalesce("times", F.lit(0)).alias("times")).where("times <> 1")
