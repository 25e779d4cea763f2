"""Recorded answers, bodies, staged outcomes and registered functions."""

import datetime
import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.functions import plain_json, quantities, sql
from evidentia.operators import evidence_counts, outcomes
from evidentia.operators.outcomes import RunAborted, Stage
from evidentia.sources import feeds, journal, links, outputs

CALLS = "kind string, request string, response string, definitive boolean"


def test_journal_is_added_to_and_replayed(spark, tmp_path):
    folder = str(tmp_path / "journal")
    calls = [("search", "a", "1", True), ("search", "b", "2", False), ("search", "c", None, True), ("identity", "a", "3", True), ("search", "a", "1", True)]
    for _ in range(2):  # a repeated run adds nothing
        journal.append(folder, spark.createDataFrame(calls, CALLS))
    held = spark.read.parquet(folder)
    assert sorted(r.response for r in held.collect()) == ["1", "3"]
    journal.append(folder, spark.createDataFrame([("search", "d", "4", True)], CALLS))
    held = spark.read.parquet(folder)
    asked = spark.createDataFrame([(k, *r) for k, r in enumerate([("search", "a"), ("search", "b"), ("search", "c"), ("search", "e"), ("identity", "z"), ("search", "d"), ("identity", "a")])], "k long, kind string, request string")
    found = {r.k: (r.source, r.response) for r in journal.replay(asked, held, {"search": 2}, "k").collect()}
    assert found == {0: ("REPLAYED", "1"), 1: ("LIVE", None), 2: ("LIVE", None), 3: ("OVER_BUDGET", None), 4: ("OVER_BUDGET", None), 5: ("REPLAYED", "4"), 6: ("REPLAYED", "3")}


def test_changed_records_answer_nothing(spark):
    held = journal.records(spark.createDataFrame([("k", "a", "1", True), ("k", "b", "2", True)], CALLS))
    asked = spark.createDataFrame([(0, "k", "a"), (1, "k", "b"), (2, None, None)], "k long, kind string, request string")
    changed = held.withColumn("response", F.when(F.col("response") == "2", "9").otherwise(F.col("response")))
    moved = held.where("response = '2'").withColumn("key", journal.request_key(F.lit("k"), F.lit("a")))
    assert {r.k: r.source for r in journal.replay(asked, changed, {}, "k").collect()} == {0: "REPLAYED", 1: "TAMPERED", 2: "OVER_BUDGET"}
    assert {r.k: r.source for r in journal.replay(asked, moved, {"k": 1}, "k").collect()} == {0: "TAMPERED", 1: "LIVE", 2: "OVER_BUDGET"}
    digest = held.where("response = '1'").first()
    assert digest.key == hashlib.sha256(b"1:ka").hexdigest() and digest.digest == hashlib.sha256((digest.key + "1").encode()).hexdigest()


def test_charsets(spark):
    said = "Größe é"
    rows = [
        (said.encode("latin-1"), "text/html; charset=ISO-8859-1"), (said.encode(), "text/html; charset=unknown"), (said.encode("latin-1"), 'text/html'),
        (b'<meta charset="latin1">' + said.encode("latin-1"), None), (said.encode("utf-16"), 'text/html; charset="UTF-16"'), (None, None), (b"", ""),
        ("a😀b".encode("utf-16-le"), "x; charset=utf-16le"), (b"\x00a\xd8\x00", "x; charset=utf-16be"), (b"a\x00b", "x; charset=utf-16le"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, body binary, kind string")
    got = [r.x for r in df.orderBy("i").select(feeds.decoded(F.col("body"), F.col("kind")).alias("x")).collect()]
    assert got[:2] == [said, said] and "\ufffd" in got[2] and got[3:8] == ['<meta charset="latin1">' + said, said, None, "", "a😀b"]
    assert got[8:] == ["\x00a\ufffd\x00", "a\x00b"]


def test_outcomes(spark):
    rows = spark.createDataFrame([(1, 5, False), (2, None, False), (3, 50, False), (None, 60, False), (3, 7, False)], "k long, v int, lost boolean")
    stages = [Stage("read", F.when(F.col("v").isNull(), "EMPTY")), Stage("check", F.when(F.col("v") > 40, F.concat(F.lit("OVER_"), "v")), aborts=F.col("lost"))]
    results, gaps = outcomes.split(rows, "k", stages)
    assert sorted((r.k, r.v) for r in results.collect()) == [(1, 5), (3, 7)] and results.columns == rows.columns
    assert {(r.k, r.stage, r.reason) for r in gaps.collect()} == {(2, "read", "EMPTY"), (3, "check", "OVER_50"), (None, "check", "OVER_60")}
    assert outcomes.coverage_faults(rows, results, gaps, "k").count() == 0
    assert [(r.k, r.given, r.found) for r in outcomes.coverage_faults(rows, results.limit(0), gaps, "k").orderBy("k").collect()] == [(1, 1, 0), (3, 2, 1)]
    with pytest.raises(RunAborted) as caught:
        outcomes.split(rows.withColumn("lost", F.lit(True)), "k", stages)
    assert caught.value.counts == {("check", "OVER_50"): 1, ("check", "OVER_60"): 1}
    empty, none = outcomes.split(rows.limit(0), "k", stages)
    assert empty.count() == none.count() == 0


def test_registered_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT lookup_key('  A \t b ') AS a, host_of('HTTP://u@H.Example:8/x') AS b, clipped(' one  two three ', 8) AS c, week_start(TIMESTAMP '2024-01-07 17:00:00') AS d").first()
    assert (row.a, row.b, row.c, str(row.d)) == ("a b", "h.example", "one two…", "2024-01-08")
    units = spark.sql("SELECT t.id, u.* FROM VALUES (1, '甲。乙'), (2, CAST(NULL AS STRING)) AS t(id, said), LATERAL prose_units(t.said) u").collect()
    assert [(r.id, r.n, r.unit) for r in units] == [(1, 1, "甲。"), (1, 2, "乙")]
    agreed = spark.sql("SELECT k, agreed(v) AS a FROM VALUES (1, 'x'), (1, 'x'), (1, NULL), (2, 'x'), (2, 'y'), (3, NULL) AS t(k, v) GROUP BY k").collect()
    assert {r.k: r.a for r in agreed} == {1: "x", 2: None, 3: None}


def test_counts_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(("a", "b", None)), f"h{rng.randrange(60)}" if k else None) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, x string, host string").repartition(7)
    got = {(r.dimension, r.value): r.n for r in evidence_counts.counted(df, F.col("k"), {"x": F.col("x"), "host": F.col("host"), "none": F.lit(None)}, capped=("host",), cap=10).collect()}
    seen = list(dict.fromkeys(h for _, _, h in rows if h))[:10]
    want = Counter(("x", x) for _, x, _ in rows if x) + Counter(("host", h if h in seen else "OTHER") for _, _, h in rows if h)
    assert got == dict(want)
    assert evidence_counts.counted(df.limit(0), F.col("k"), {"x": F.col("x")}).count() == 0


def test_plain_json(spark):
    texts = ['plain "quoted" \\ back', "line\nend\r\t\b\f\x01\x1f", "億 é 😀", "", None]
    doubles = [0.0, -0.0, 1.0, 0.1, -2.5, 1e16, 123456789012345680.0, 1e-4, 1.5e-5, 1e22, 12345678.9, 1e7, 123456789.125, 9999999.0, 1.5e-300, 1.7976931348623157e308, None]
    schema = "i int, t string, n struct<d: double, l: array<struct<b: boolean, t: string>>, m: map<string, int>, day: date, none: array<int>>"
    rows = [(k, texts[k % 5], (v, [(True, texts[(k + 1) % 5]), (None, None), None], {"b": 2, "a": None, "ä": 1}, datetime.date(2024, 2, 29) if k % 2 else None, [] if k % 3 else None)) for k, v in enumerate(doubles)]
    df = spark.createDataFrame([*rows, (99, None, None)], schema)
    kind = df.schema
    found = df.select("i", plain_json.plain(F.struct(*df.columns), kind).alias("x"), plain_json.payload_size(F.struct(*df.columns), kind).alias("n")).collect()

    def python(row) -> dict:
        i, t, n = row
        return {"i": i, "t": t, "n": n and {"d": n[0], "l": [x and dict(zip("bt", x, strict=True)) for x in n[1]], "m": dict(sorted(n[2].items())), "day": n[3] and n[3].isoformat(), "none": n[4]}}

    want = {r[0]: json.dumps(python(r), ensure_ascii=False) for r in [*rows, (99, None, None)]}
    for r in found:
        assert r.x == want[r.i]
    assert {r.i: r.n for r in found} == {i: len(x) for i, x in want.items()}


def test_outputs_appear_together_or_not(spark, tmp_path):
    folder = str(tmp_path)
    good = spark.range(5)
    failing = good.select(F.raise_error(F.lit("lost")).cast("string").alias("x"), "id")
    assert outputs.published(spark, folder, "r1") == {}
    with pytest.raises(Exception, match="lost"):
        outputs.publish({"a": good, "b": failing}, folder, "r1")
    assert outputs.published(spark, folder, "r1") == {}
    outputs.publish({"a": good, "b": good.limit(0)}, folder, "r1")
    assert {k: v.count() for k, v in outputs.published(spark, folder, "r1").items()} == {"a": 5, "b": 0}
    with pytest.raises(Exception, match="lost"):  # a repeated run that fails leaves nothing of either
        outputs.publish({"a": good, "b": failing}, folder, "r1")
    assert outputs.published(spark, folder, "r1") == {}
    for bad in ({}, {"manifest": good}, {"../x": good}):
        with pytest.raises(ValueError):
            outputs.publish(bad, folder, "r2")


def test_links_of_equal_urls_keep_their_rows(spark):
    """Two pages with one opaque url and several recorded answers: a row each, and with a key the answer of the page."""
    url = "https://news.example.org/rss/articles/CBMxx?oc=5"
    pages = spark.createDataFrame([(1, url), (2, url)], "page_id long, url string")
    recorded = spark.createDataFrame([(2, url, "https://b.example/"), (2, url, "https://a.example/"), (4, url, "https://c.example/")], "page_id long, url string, publisher_url string")
    told = lambda *key: sorted((r.page_id, r.publisher_url, r.method) for r in links.resolved_links(pages, recorded, "news.example.org", "example.net", *key).collect())
    assert told() == [(1, "https://a.example/", "RECORDED"), (2, "https://a.example/", "RECORDED")]
    assert told(("page_id", "url")) == [(1, None, "UNRESOLVABLE"), (2, "https://a.example/", "RECORDED")]


def test_documents_are_taken_apart_once(spark):
    """No filter of a plan repeats what takes a feed or a text apart."""
    df = spark.createDataFrame([(1, "<rss><channel/></rss>")], "feed_id long, body string")
    for found, step in ((feeds.feed_items(df), "from_xml("), (quantities.stated(df, "feed_id", F.col("body")), "regexp_replace(")):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert step in plan and not any(step in line for line in plan.splitlines() if line.strip(" :+-").startswith("Filter"))
