"""What a step holds as its tables grow."""

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.functions import quantities, urls
from evidentia.operators import entities, evidence_counts, review
from evidentia.plans import prose
from evidentia.sources import tables


def _structure(spark, count=None):
    a = spark.createDataFrame([(1, "u1", None), (1, "u2", "r1"), (2, "u1", "r9"), (3, "u1", None), (3, "u1", None), (4, "u1", None), (4, "u2", "r1"), (5, "u1", None), (6, None, None), (8, "r1", "r1"), (9, "u1", "u1")], "event_id long, unit_id string, reference string")
    u = spark.createDataFrame([(1, "u1"), (1, "u2"), (1, "u2"), (2, "u1"), (3, "u1"), (4, "u1"), (5, "u1"), (5, "u2"), (6, None), (7, "u1"), (8, "r1"), (9, "u1"), (None, "u1")], "event_id long, unit_id string")
    k = spark.createDataFrame([(1, "r1"), (1, "r1"), (4, "r1"), (10, "r1"), (8, "r1")], "event_id long, reference string")
    return review.structure(a, u, k, count)


def test_structure(spark):
    """Repeats on the given sides count once, null ids equal nothing, units and references of one name stay apart."""
    want = {1: None, 2: "CITATION", 3: "REPEATED_UNIT", 4: "EXTRA_UNIT", 5: "MISSING_UNIT", 6: "MISSING_UNIT", 7: "MISSING_UNIT", 8: None, 9: "CITATION", None: "MISSING_UNIT"}
    assert {r.event_id: r.violation for r in _structure(spark).collect()} == want


def test_structure_is_dealt_by_rows(spark, monkeypatch):
    """No side is sorted for a join, and tasks grow in number with the rows."""
    monkeypatch.setattr(tables, "PER_TASK", 2)
    found = _structure(spark, 40)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("REPARTITION_BY_NUM") == 2 and "20), REPARTITION_BY_NUM" in plan
    assert found.count() == 10


def test_counts_of_batches_are_grouped_together(monkeypatch):
    """Batches wait for each other, and however many wait or are held, sums and first places are the same."""
    batches = [pa.RecordBatch.from_pydict({"__at": pa.array([10 - i, 20 + i], pa.int64()), "x": pa.array(["a", None]), "y": pa.array([f"v{i}", "a"])}) for i in range(6)]
    want = {("x", "a"): (6, 5), ("y", "a"): (6, 20)} | {("y", f"v{i}"): (1, 10 - i) for i in range(6)}
    grouped = list(evidence_counts._summed(iter(batches)))
    assert sum(b.num_rows for b in grouped) == len(want)
    for waiting, held in ((32 << 20, 50_000), (0, 50_000), (0, 0), (100, 3)):
        monkeypatch.setattr(evidence_counts, "WAITING", waiting)
        monkeypatch.setattr(evidence_counts, "HELD", held)
        got = {}
        for b in evidence_counts._summed(iter(batches)):
            for dimension, value, n, first in zip(*b.to_pydict().values(), strict=True):
                before = got.get((dimension, value), (0, first))
                got[dimension, value] = (before[0] + n, min(before[1], first))
        assert got == want
    assert list(evidence_counts._summed(iter([]))) == []


def test_host_as_by_its_patterns(spark):
    """Users, ports and www go as the patterns say, in urls of any shape."""
    said = [None, "", "x", "://a", "http://", "HTTPS://User@WWW.H.Example:80/a", "http://u@v@h:1:2?q", "http://h:/", "http://www.:80", "http://WWW.", "http://www.www.a", "http://a\nb@c:80\n/x", "http://h:80\n", "ftp+x.1-y://é.İ:9#f", "1http://a", "http://@", "http://:8", "http://u:p@www.h", "a http://b", "http://h:8x"]
    df = spark.createDataFrame([(u,) for u in said], "u string")
    bare = F.regexp_replace(F.lower(F.regexp_extract("u", r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", 2)), r"^.*@|:\d*$", "")
    rows = df.select("u", urls.host(F.col("u")).alias("got"), F.regexp_replace(bare, r"^www\.", "").alias("want")).collect()
    assert [(r.u, r.got) for r in rows] == [(r.u, r.want) for r in rows]


def test_small_components_share_tasks(spark):
    """Components are placed one after the other in a few tasks of Arrow batches, not in a call of pandas for each; pairs
    that repeat, are turned or name unknown records change nothing."""
    n = 3_000
    ids = spark.range(n * 3).withColumnRenamed("id", "candidate_id")
    records = ids.select("candidate_id", F.col("candidate_id").alias("order_key"), F.when(F.col("candidate_id") % 9 == 1, "x").when(F.col("candidate_id") % 9 == 2, "y").alias("region"))
    first = ids.where("candidate_id % 3 = 0").select(F.col("candidate_id").alias("left_id"))
    pairs = [first.select("left_id", (F.col("left_id") + k).alias("right_id")) for k in (1, 2)]
    pairs = [*pairs, first.select(F.col("left_id") + 2, F.col("left_id") + 1), pairs[0], first.select("left_id", F.lit(-1).cast("long")).limit(5)]
    related = pairs[0]
    for more in pairs[1:]:
        related = related.union(more)
    found = entities.complete_link_groups(records, related.withColumn("relation", F.lit("SAME_EVENT")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroupsInPandas" not in plan
    got = {r.candidate_id: r.group_id for r in found.collect()}
    assert got == {i: i if i % 9 == 2 else i - i % 3 for i in range(n * 3)}


def test_equal_texts_are_taken_apart_once(spark, monkeypatch):
    """Quantities of texts that repeat come from one row for each text, for few and for many of them; no row of
    numeric_grounding is taken apart by itself."""
    rows = spark.createDataFrame([(1, "US$5 million and 3 km"), (2, "US$5 million and 3 km"), (2, "nothing"), (3, None), (None, "1,5 t"), (4, "US$5 million and 3 km"), (4, "")], "k long, said string")
    want = sorted(map(str, quantities.stated(rows, "k", F.col("said")).collect()))
    for few in (quantities.FEW, 0):
        monkeypatch.setattr(quantities, "FEW", few)
        assert sorted(map(str, quantities.stated_by_text(rows, "k", F.col("said")).collect())) == want
    assert len(want) == 7
    plan = prose.numeric_grounding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan


def _facts(spark, rows):
    """Records of (id, subject, asset)."""
    text = "cast(null as string)"
    df = spark.createDataFrame(rows, "candidate_id long, subject string, asset string")
    return df.selectExpr("*", "cast(null as date) occurrence_date", "'a' action", "'b' lifecycle_step", "'c' occurrence_context", *[f"{text} {c}" for c in ("project", "package", "location")])


def test_components_are_settled_in_their_blocks(spark, monkeypatch):
    """Where each record is in one block no round over edges is needed; records in several blocks take them."""
    called = []
    components = entities.components
    monkeypatch.setattr(entities, "components", lambda edges: called.append(1) or components(edges))
    one = [(1, "s", "x"), (2, "s", None), (3, "s", "y"), (4, "t", "x"), (5, "t", "y"), (5, "t", "x"), (6, "u", "x"), (7, "u", "x"), (7, "u", "x")]
    found = entities.fact_components(_facts(spark, one))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6)]
    assert not called
    several = [*one, (8, None, "x"), (9, None, "y"), (10, "v", None)]
    found = entities.fact_components(_facts(spark, several))
    assert sorted(map(tuple, found.collect())) == [*((k, 1) for k in range(1, 10))]
    assert called


def test_records_go_where_they_may_meet_first():
    assert entities._meeting_places({0b1, 0b11}) == {0: [1, 3], 1: [], 2: [], 3: [], 4: []}
    assert entities._meeting_places({0b1, 0b11, 0b10}) == {0: [1, 3], 1: [2, 3], 2: [], 3: [], 4: []}
    assert entities._meeting_places({0b101, 0b110}) == {0: [5], 1: [6], 2: [5, 6], 3: [], 4: []}


def test_links_of_blocks_are_handed_on_at_their_ends(monkeypatch):
    rows = [(1, 3, 2), (1, 5, 4), (1, 4, 2), (2, 9, 8), (2, 8, 7), (3, 5, 1)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("block", "id", "other"), map(list, zip(*rows[k : k + 2], strict=True)), strict=True))) for k in (0, 2, 4)]
    monkeypatch.setattr(entities, "LINKED", 0)
    found = [sorted(zip(*b.to_pydict().values(), strict=True)) for b in entities._block_roots(batches)]
    assert found == [[(2, 2), (3, 2), (4, 2), (5, 2)], [(7, 7), (8, 7), (9, 7)], [(1, 1), (5, 1)]]
