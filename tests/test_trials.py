"""Opaque links, addresses, vocabularies, answers, leaks, seals and cut requests by value tables."""

import base64

import pytest
from pyspark.sql import functions as F

from evidentia.operators import audit, trials
from evidentia.sources import contracts, links


def opaque(url: bytes, marker=b"\x08\x13\x22") -> str:
    size = bytes([len(url)]) if len(url) < 128 else bytes([len(url) % 128 + 128, len(url) // 128])
    return base64.urlsafe_b64encode(marker + size + url + b"\xd2\x01\x00").decode().rstrip("=")


def test_embedded_urls(spark):
    long_url = b"https://x.com/" + b"y" * 300
    cases = {
        opaque(b"https://x.com/a"): "https://x.com/a", opaque(long_url): long_url.decode(), opaque("https://x.com/é".encode()): "https://x.com/é",
        opaque(b"AU_yqLxyz"): None, opaque(b"ftp://x.com/"): None, opaque(b"https://own.org/"): None, opaque(b"https://a.OWN.org/"): None,
        opaque(b"https://x.com/\xff"): None, opaque(b"https://x.com/", b"\x08\x13\x23"): None, opaque(b""): None, "a": None, "": None, "CBMi": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "id string").select("id", links.embedded_url(F.col("id"), "own.org").alias("url"))
    assert {r.id: r.url for r in df.collect()} == {**cases, None: None}


def test_link_ids(spark):
    cases = {
        "https://news.x.org/rss/articles/AB-_c?x": "AB-_c", "https://NEWS.x.org/read/q/z": "q", "https://news.x.org/articles/": None,
        "https://a.news.x.org/articles/q": None, "https://newsax.org/articles/q": None, "x": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").select("url", links.link_id(F.col("url"), "news.x.org").alias("id"))
    assert {r.url: r.id for r in df.collect()} == cases


def test_public_ip(spark):
    cases = {
        "8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "169.254.1.1": False, "100.64.0.1": False, "224.0.0.1": False, "240.0.0.1": False, "0.0.0.0": False,
        "2001:4860:4860::8888": True, "::1": False, "::": False, "fe80::1": False, "fc00::1": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "ff02::1": False,
        "8.8.8": False, "08.8.8.8": False, "x": False, "": False,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string").select("a", links.public_ip("a").alias("p"))
    assert {r.a: r.p for r in df.collect()} == {**cases, None: False}


def test_vocabulary(spark):
    text = "* `A`: x = no.\n## V\n* `A`: x = no.\n### `p` — one\n* `A`: g = a, b c; `h = d`.\nnothing\n* `B`: g = a,,b; k = {MONITORED_STANDARDS}, z.\n### `q` — two\n* `A`: nothing here.\n* `A`: m = {MONITORED_STANDARDS}.\n## W\n### `r` — no\n* `A`: x = no."
    terms = contracts.vocabulary(spark.createDataFrame([(1, text), (2, ""), (3, None)], "document_id int, text string"), "## V", "## W", ("EN 1", "EN 2"))
    assert sorted(map(tuple, terms.drop("document_id").collect()), key=str) == sorted([
        ("p", "A", "g", 0, "a", False), ("p", "A", "g", 1, "b c", False), ("p", "A", "h", 0, "d", False), ("p", "B", "g", None, None, True),
        ("p", "B", "k", None, None, True), ("q", "A", "m", 0, "EN 1", False), ("q", "A", "m", 1, "EN 2", False),
    ], key=str)
    assert [r.profile for r in contracts.incomplete_profiles(terms, ("A", "B")).collect()] == ["q"]


@pytest.mark.parametrize(("content", "status"), [
    ('{"a":1}', "PLAIN"), ('{"a":1},"status":"complete"}{"a":1}', "RECOVERED"), (' {"a":1}{ "a": 1 } ', "RECOVERED"), ('{"a":{}} {} {"a":{}}', "RECOVERED"),
    ('{"a":1}{"a":2}', "INVALID"), ('{"a":1}{"a":1}x', "INVALID"), ('{"a":1} x', "INVALID"), ("{}{}", "INVALID"), ('"a"', "NOT_AN_OBJECT"), ("", "INVALID"), (None, "NO_CONTENT"),
])
def test_answers(content, status):
    assert trials._answer(content)[1] == status


def test_leaks(spark):
    rows = [(1, '{"a":{"b":[{"gold" :2}]}}', ""), (2, '{"a":["gold",":","\\"gold\\":"]}', None), (33, '{"n":"x33y f.json"}', "f.json"), (4, None, "f")]
    df = trials.leaks(spark.createDataFrame(rows, "case_id int, payload string, file_name string"), ("gold",))
    assert sorted(map(tuple, df.collect())) == [(1, "KEY"), (33, "CASE_ID"), (33, "FILE_NAME")]


def test_seals(spark):
    good = [(r, "v", "c", "OK", "d", 0) for r in (1, 2, 3)]
    batches = {
        "pass": (good, "PASS", None, []),
        "finds": ([*good[:1], (2, "v", "c", "OK", "d", 4), (3, "v", "c", "OK", "d", None)], "FINDINGS", None, [2, 3]),
        "two": (good[:2], "BLOCKED", "ROUNDS_MISSING_OR_EXTRA", []),
        "twice": ([*good[:2], good[1]], "BLOCKED", "ROUND_NUMBERS", []),
        "moved": ([*good[:2], (3, "v", "c2", "OK", "d", 0)], "BLOCKED", "CONFIGURATION_NOT_FROZEN", []),
        "none": ([*good[:2], (3, "v", None, "OK", "d", 0)], "BLOCKED", "CONFIGURATION_NOT_FROZEN", []),
        "unseen": ([*good[:2], (3, "v", "c", None, "d", 0)], "BLOCKED", "DEPLOYMENT_NOT_FROZEN", []),
    }
    rows = [(k, *r) for k, (rounds, *_) in batches.items() for r in rounds]
    df = spark.createDataFrame(rows, "batch string, round int, acceptance string, configuration string, deployment_status string, deployment string, errors int")
    got = {r.batch: (r.verdict, r.blocker, r.failed_rounds) for r in trials.sealed(df, "batch", 3, {"errors": 0}, "OK", "v").collect()}
    assert got == {k: tuple(v[1:]) for k, v in batches.items()}


def test_cut_requests(spark):
    rows = [("a", k, k, size) for k, size in enumerate([4, 4, 9, 20, 1, 1, 0, 9])] + [("b", 1, 1, 1)]
    df = trials.cut_requests(spark.createDataFrame(rows, "run string, record int, position int, size int"), 10)
    assert sorted(map(tuple, df.collect())) == [("a", 0, 1), ("a", 1, 1), ("a", 4, 2), ("a", 5, 2), ("a", 6, 2)]
    assert trials.cut_requests(spark.createDataFrame([], "run string, record int, position int, size int"), 10).count() == 0


def test_series_and_hyphen_years(spark):
    said = [("IEC 60076:2026 SER and EN 50122-2:2010", ["EN 50122-2:2010"]), ("IEC 60076 SER", []), ("IEC 60076 SERVICE", ["IEC 60076"]), ("IEC 60076-11 SER, IEC 61373-2010", ["IEC 61373-2010"])]
    df = spark.createDataFrame([(t,) for t, _ in said], "t string").select("t", audit.identifiers(F.col("t"), ("EN", "IEC")).alias("i"))
    assert {r.t: r.i for r in df.collect()} == dict(said)
    owner_of = spark.createDataFrame([("IEC 61373", "IEC 61373"), ("IEC 60076-2018", "IEC 1")], "publication string, owner string")
    named = spark.createDataFrame([("IEC 61373-2010",), ("IEC 61373:2010",), ("IEC 60076-2018",), ("IEC 60076-2017",)], "identifier string")
    assert {r.identifier: r.owner for r in audit.owned(named, owner_of).collect()} == {
        "IEC 61373-2010": "IEC 61373", "IEC 61373:2010": "IEC 61373", "IEC 60076-2018": "IEC 1", "IEC 60076-2017": None,
    }
