"""Whole runs: integrity of their stages, their audit, and their replay."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import audit_star, discovery, replay, review
from evidentia.operators.integrity import run_faults

RESULTS = "stage string, candidate_id long, state string, position long"
GAPS = "stage string, subject_id long, failure_class string"


def faults(spark, results, gaps=(), candidates=((1, 1), (2, 2), (3, 3)), **more):
    found = run_faults(spark.createDataFrame(list(candidates), "candidate_id long, position long"), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(list(gaps), GAPS), **more)
    return sorted((r.stage, r.candidate_id or 0, r.fault) for r in found.collect())


SOUND = [("evidence", 1, "READY", 1), ("evidence", 2, "REJECTED", 2), ("scope", 1, "IN_SCOPE", 1), ("temporal", 1, "VALID", 1), ("identity", 1, "GROUPED", 1)]
GAP = [("evidence", 3, "TIMEOUT")]


def test_sound_runs_have_no_faults(spark):
    assert faults(spark, SOUND, GAP) == []
    assert faults(spark, SOUND[:2], GAP) == []  # a run that ended after a stage
    assert faults(spark, [], []) == []
    assert faults(spark, [], [], candidates=()) == []


def test_every_fault(spark):
    assert faults(spark, SOUND) == [("evidence", 3, "NO_RESULT")]
    assert faults(spark, SOUND, GAP, blocked=True) == [(s, 0, "BLOCKED") for s in ("evidence", "identity", "scope", "temporal")]
    assert faults(spark, [*SOUND, ("scope", 2, "IN_SCOPE", 2)], GAP) == [("scope", 2, "NO_INPUT"), ("temporal", 2, "NO_RESULT")]
    assert faults(spark, SOUND, [*GAP, GAP[0], ("scope", 9, "X"), ("nowhere", 1, "X")]) == [("evidence", 3, "REPEATED_GAP"), ("nowhere", 1, "UNKNOWN_STAGE"), ("scope", 9, "UNKNOWN_SUBJECT")]
    assert faults(spark, [*SOUND, SOUND[1]], [*GAP, ("evidence", 1, "X")]) == [("evidence", 1, "RESULT_DESPITE_GAP"), ("evidence", 2, "REPEATED_RESULT")]
    swapped = [("evidence", 1, "REJECTED", 2), ("evidence", 2, "REJECTED", 1)]
    assert faults(spark, swapped, GAP) == [("evidence", 1, "OUT_OF_ORDER"), ("evidence", 2, "OUT_OF_ORDER")]
    assert faults(spark, [*SOUND[:2], SOUND[4]], GAP) == [("identity", 0, "NO_PREDECESSOR"), ("identity", 1, "NO_INPUT")]
    # one group may have gaps of several classes, but not two of one
    classed = [("identity", 1, "A"), ("identity", 1, "B")]
    assert faults(spark, SOUND[:4], [*GAP, *classed]) == []
    assert faults(spark, SOUND[:4], [*GAP, *classed, classed[0]]) == [("identity", 1, "REPEATED_GAP")]
    assert faults(spark, SOUND, GAP, candidates=((1, 1), (2, 2), (3, 3), (3, 4))) == [("candidates", 3, "REPEATED_CANDIDATE")]


def sides(spark, **rows):
    return {n: spark.createDataFrame(rows.get(n, []), "candidate_id long, state string, reason string") for n, _ in audit_star.STAGES}


def test_audit_joins_without_moving(spark):
    good = {n: [(1, s, None)] for n, s in audit_star.STAGES}
    good["evidence"] = [(1, "READY", None), (2, "REJECTED", "EMPTY"), (3, "READY", None), (4, "READY", None)]
    good["scope"] = [(1, "IN_SCOPE", None), (4, "IN_SCOPE", None)]
    candidates = spark.createDataFrame([(k,) for k in range(1, 6)], "candidate_id long")
    gaps = spark.createDataFrame([(3, "scope", "TIMEOUT")], "candidate_id long, stage string, reason string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        audited = audit_star.star(candidates, sides(spark, **good), gaps, buckets=4)
        assert "Exchange" not in audited._jdf.queryExecution().executedPlan().toString()
        found = {r.candidate_id: (r.terminal_stage, r.terminal_state, r.reason) for r in audit_star.selection(audited).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert found == {
        1: ("writer", "REPORTED", None), 2: ("evidence", "REJECTED", "EMPTY"), 3: ("scope", "TECHNICAL_GAP", "TIMEOUT"), 4: ("temporal", "NOT_REACHED", None), 5: ("evidence", "NOT_REACHED", None)
    }
    with pytest.raises(ValueError, match="scope has candidate_id 1 more than once"):
        audit_star.star(candidates, sides(spark, scope=[(1, "OUT", None), (1, "IN_SCOPE", None)]), gaps, buckets=4)


def test_records_are_rebuilt_with_their_spans(spark):
    """Records of one content have one body, and every span is the sentence that was cited."""
    rng = random.Random(2)
    rows = [(k, rng.choice(("h1", "h2", None)), rng.choice((None, [], [f"S{rng.randrange(1, 1200)}", "S2"])), rng.choice(("r", None))) for k in range(20)]
    found = {r.candidate_id: r for r in replay.rebuilt(spark.createDataFrame(rows, "candidate_id long, content_sha256 string, excerpt array<string>, region_id string")).collect()}
    for k, key, cited, region in rows:
        r, key = found[k], key or str(k)
        most = max(int(s[1:]) for i, h, c, _ in rows if (h or str(i)) == key for s in (c or ["S1"]))
        assert r.body == "\n".join(f"{key} sentence {i}." for i in range(1, most + 1)) + (f"\nRegion {region}" if region else "")
        assert [r.body[x.start : x.end] for x in r.focus] == [f"{key} sentence {s[1:]}." for s in (cited or ["S1"])]


def test_changed_proposals_are_refused(spark):
    schema = "candidate_id long, title string, content string, metadata struct<a: int>, proposal struct<s: string>, parse_status string"
    saved = replay.saved(spark.createDataFrame([(1, "t", "c", (1,), ("x",), "PARSED"), (2, "t", None, (1,), ("x",), "PARSED"), (3, "t", "c", (1,), None, "INVALID")], schema))
    state = lambda df: {r.candidate_id: (r.status, r.reason) for r in replay.replayable(df).collect()}
    assert state(saved) == {1: ("READY", None), 2: ("FAIL", "SOURCE_CONTENT_DIGEST_MISMATCH"), 3: ("BLOCKED", "NO_REPLAYABLE_PARSED_PROPOSAL")}
    one = saved.where("candidate_id = 1")
    for column, value, reason in (
        ("version", F.lit("v"), "UNSUPPORTED_VERSION"), ("metadata", F.struct(F.lit(2).alias("a")), "SOURCE_METADATA_DIGEST_MISMATCH"), ("title", F.lit("u"), "REQUEST_IDENTITY_DIGEST_MISMATCH"),
        ("proposal", F.struct(F.lit("y").alias("s")), "PROPOSAL_DIGEST_MISMATCH"), ("proposal_sha256", F.lit(None).cast("string"), "PROPOSAL_DIGEST_MISMATCH"),
    ):
        assert state(one.withColumn(column, value)) == {1: ("FAIL", reason)}


def test_plan_order_and_alignment(spark):
    """Items numbered by nine keys wherever they stand; results of events matched by key."""
    rng = random.Random(9)
    columns = list(discovery.ORDER)
    rows = [tuple(rng.choice((None, "a", "b")) for _ in columns[:-1]) + (str(k),) for k in range(200)]
    items = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(6)
    got = {r.position: tuple(r[c] for c in columns) for r in discovery.canonical_order(items).collect()}
    order = sorted(rows, key=lambda r: [(v is not None, v or "") for v in r])
    assert [got[k + 1] for k in range(200)] == order
    frame = lambda ids, c: spark.createDataFrame([(i, f"{c}{i}") for i in ids], f"event_id long, {c} string")
    found = {r.event_id: (r.g, r.m, r.c, r.fault) for r in review.aligned(frame([3, 1, 2], "g"), frame([1, 2, 3, 4], "m"), frame([2, 2, 1, 3], "c")).collect()}
    assert found == {1: ("g1", "m1", "c1", None), 3: ("g3", "m3", "c3", None), 2: (None, None, None, "REPEATED"), 4: (None, None, None, "MISSING")}


def test_citations(spark):
    cited = [(1, 1, "A", "S2"), (1, 2, "B", "S1"), (1, 3, "A", "S2"), (2, 1, "A", "S1"), (2, 2, "Z", "S1"), (3, 1, "A", "S9"), (3, 2, "Z", "S1")]
    refs = [(1, "A", 10), (1, "B", 20), (2, "A", 10), (3, "A", 10)]
    told = [(10, "S1", 0, 4), (10, "S2", 5, 9), (20, "S1", 0, 7)]
    found = review.citation_spans(
        spark.createDataFrame(cited, "subject_id long, ordinal long, source_ref string, sentence_id string"), spark.createDataFrame(refs, "subject_id long, source_ref string, candidate_id long"),
        spark.createDataFrame(told, "candidate_id long, sentence_id string, start int, end int"),
    )
    assert {r.subject_id: (r.reason, r.spans and [tuple(s) for s in r.spans]) for r in found.collect()} == {1: (None, [(10, 5, 9), (20, 0, 7)]), 2: ("UNKNOWN_SOURCE", None), 3: ("UNRESOLVED_SENTENCE", None)}
