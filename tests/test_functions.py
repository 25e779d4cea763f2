"""Value tables for text, url and date expressions, pages, feeds, proposals and the ledger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates, ids, quantities, segments, text, urls
from evidentia.operators import constraints, proposals, temporal
from evidentia.sources import feeds
from evidentia.sources.html import read_page, segment_of
from evidentia.streaming import ledger


def values(spark, expression, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_sentences(spark):
    cases = {
        "One ends. Two ends! Three": ["One ends.", "Two ends!", "Three"],
        "Dr. Low met Mr. High. they left": ["Dr. Low met Mr. High. they left"],
        "See Nos. Five. Next": ["See Nos. Five.", "Next"],
        "Costs 3.5 now. 4 more": ["Costs 3.5 now. 4 more"],
        "line\nnext": ["line", "next"],
        "全部完成。下一句！最后": ["全部完成。", "下一句！", "最后"],
        "什麼！？好。": ["什麼！？", "好。"],
        "她說「好。」然後走了。": ["她說「好。」", "然後走了。"],
        'He said "stop." Then he left.': ['He said "stop."', "Then he left."],
        "Plan B. Next": ["Plan B. Next"],
        "x((((...st. Next one.": ["x((((...st.", "Next one."],
        "(" * 100 + "st. Next": ["(" * 100 + "st. Next"],
        "y" * 100 + "st. Next": ["y" * 100 + "st.", "Next"],
        "Really?! Yes...  \t": ["Really?!", "Yes..."],
        "": [],
        None: [],
    }
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    found: dict = {}
    for r in segments.sentences(df, "i", F.col("x")).orderBy("i", "start").collect():
        found.setdefault(r.i, []).append(r)
    for i, (original, want) in enumerate(cases.items()):
        rows = found.get(i, [])
        assert [r.text for r in rows] == want
        assert [r.id for r in rows] == [f"S{k + 1}" for k in range(len(rows))]
        assert all(original[r.start : r.end] == r.text for r in rows)


def test_units_make_up_the_text():
    for text_ in ("甲。\n乙！？」 丙\n***\n丁", "***", "a\n\n。b", "no end", "x。***"):
        spans = segments.unit_spans(text_)
        assert "".join(text_[a:b] for a, b in spans) == text_
        assert all(any(c.isalnum() for c in text_[a:b]) for a, b in spans) or len(spans) == 1


QUANTITIES = {
    "It cost $5m and 3.5 million euros": [(5e6, quantities.DOLLARS), (3.5e6, ("EUR",))],
    "3 million, 3 billion": [(3e6, ()), (3e9, ())],
    "1兆9000億円": [(1.9e12, ("JPY",))],
    "5,000 crore rupees": [(5e10, quantities.RUPEES)],
    "20 000 km": [(2e7, ("length",))],
    "5-10%": [(5.0, ("percent",)), (10.0, ("percent",))],
    "between 5 and 10 km": [(5e3, ("length",)), (1e4, ("length",))],
    "1,234 items": [(None, ())],
    "1,234 items, 5.5 kg": [(1234.0, ()), (5.5, ())],
    "1,5 million and 2,75 and 1.234": [(1.5e6, ()), (2.75, ()), (1234.0, ())],
    "5,000～10,000億円": [(5e11, ("JPY",)), (1e12, ("JPY",))],
    "NT$5億元": [(5e8, ("TWD",))],
    "₹5,000 crore to ₹10,000 crore": [(5e10, ("INR",)), (1e11, ("INR",))],
    "1,25,000; 12.5km²": [(125_000.0, ()), (1.25e7, ("area",))],
    "1.234.567,89": [(1_234_567.89, ())],
    "5 000 miles": [(5000.0, ("mile",))],
    "20 2026": [(20.0, ()), (2026.0, ())],
    "no number": [],
}


def test_quantities(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*QUANTITIES, None])], "i int, x string")
    found: dict = {}
    for r in quantities.stated(df, "i", F.col("x")).orderBy("i", "ordinal").collect():
        found.setdefault(r.i, []).append((r.value, tuple(r.unit)))
    for i, (text_, want) in enumerate(QUANTITIES.items()):
        assert found.get(i, []) == [(v, tuple(sorted(u))) for v, u in want], text_


VALUES = {
    "₹5,000 crore to ₹10,000 crore": [5e10, 1e11], "1조 9000억 원": [1.9e12], "3만4000人": [34000.0], "16,4 millones de euros": [16.4e6], "$1.93 billion": [1.93e9], "€800 millions": [8e8],
    "The line is 1,234 km long and costs $1.5 billion.": [1.234e6, 1.5e9], "Die Strecke ist 1,234 km lang und kostet 1,5 Mrd. Euro.": [1234.0, 1.5e9],
    "Le projet de 1.234 km coûtera 2,5 milliards d'euros.": [1.234e6, 2.5e9], "The line is 1,234 km long.": [None], "A contract of 91.766 billion KRW": [9.1766e10],
    "Kosten von 1.250 Millionen Euro": [1.25e9], "Kosten von 1.234 Millionen Euro": [None], "Orders of ₹2,500 crore": [2.5e10], "₹1,25,000 crore": [1.25e12],
    "1.234.567 passengers": [1234567.0], "1,234,567.5 passengers": [1234567.5], "1.234.567,5 passengers": [1234567.5], "0,500 km": [500.0], "16,4 km": [16400.0], "運賃は1,234円": [1234.0],
}


def test_values(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, x string")
    found: dict = {}
    for r in quantities.stated(df, "i", F.col("x")).orderBy("i", "ordinal").collect():
        found.setdefault(r.i, []).append(r.value)
    for i, (text_, want) in enumerate(VALUES.items()):
        assert found[i] == [v if v is None else pytest.approx(v) for v in want], text_


def test_units_and_what_is_checked(spark):
    one = spark.createDataFrame([(1, "a 31-km line, 42 miles, 2.3 percentage points, up 37%, €16.4m, 300억 원")], "i int, x string")
    got = {r.raw: r.unit for r in quantities.stated(one, "i", F.col("x")).collect()}
    assert got == {"31-km": ["length"], "42 miles": ["mile"], "2.3 percentage points": ["percentage_point"], "37%": ["percent"], "16.4m": ["EUR"], "300억 원": ["KRW"]}
    two = spark.createDataFrame([(1, "2026年10月27日，共19站、全長31公里，增加37%，經費1,640萬歐元，34列"), (2, "5,000億至1兆")], "i int, x string")
    found = quantities.checked(quantities.stated(two, "i", F.col("x"), report=True)).orderBy("i", "ordinal").collect()
    assert [(r.raw, r.value) for r in found] == [("31公里", 31000.0), ("37%", 37.0), ("1,640萬歐元", 16.4e6), ("5,000億", 5e11), ("1兆", 1e12)]


@pytest.mark.parametrize(
    ("written", "evidence", "good"),
    [
        ("約500萬元", "It cost NT$5 million", True), ("5億元", "NT$500 million", True), ("新臺幣5億元", "5億元", False), ("1.2公里", "1,255 m and 5.5 m", False), ("1.2公里", "1,245 m and 5.5 m", True), ("1.2公里", "1.23 km", True),
        ("12公里", "12 miles", False), ("12,345", "12345 passengers", True), ("30%", "30 percent", True), ("30%", "30", False), ("8", "nothing", True),
    ],
)
def test_grounding(spark, written, evidence, good):
    frame = lambda t: spark.createDataFrame([(1, t)], "i int, x string")
    told = quantities.checked(quantities.stated(frame(written), "i", F.col("x"), report=True))
    assert (quantities.without_evidence(told, quantities.stated(frame(evidence), "i", F.col("x")), "i").count() == 0) == good


def test_occurrences(spark):
    assert values(spark, lambda c: text.occurrences(c, "aa"), ["aaaa", "baab", "", "a"]) == [[0, 1, 2], [1], [], []]
    assert values(spark, lambda c: text.occurrence_count(c, "aa"), ["aaaa", "baab", "", "a"]) == [3, 1, 0, 0]
    assert values(spark, lambda c: text.same_label_spans(c, "Ab"), ["xaBAB", "İab"]) == [[(1, 3), (3, 5)], []]
    assert values(spark, text.mixed_script_words, ["서울市 서울 市"]) == [["서울市"]]
    assert values(spark, text.places_listed, ["A, B and C、D"]) == [["A", "B", "C", "D"]]


def test_urls(spark):
    u = ["HTTPS://User@WWW.Example.com:443/a/?utm_source=x&b=1&fbclid=2#top", "http://example.com", "http://exa mple.com/", "ftp://example.com/", "http://example.com/%zz", "http://example.com:99999/"]
    assert values(spark, urls.strip_tracking, u[:2]) == ["HTTPS://User@WWW.Example.com:443/a/?b=1", "http://example.com"]
    encoded = ["http://h/?utm%5Fsource=x", " https://h/a?%66bclid=1&a%zz=2&&b+c=3#f", "http://h:99999/?a=1", "mailto:x@y", "http://h/?a=1&utm_x"]
    assert values(spark, urls.strip_tracking, encoded) == ["http://h/", "https://h/a?a%zz=2&&b+c=3", "", "", "http://h/?a=1"]
    assert values(spark, urls.resource_key, u[:2]) == ["https|example.com||/a/|utm_source=x&b=1&fbclid=2", "http|example.com||/|"]
    assert values(spark, urls.exact, u) == [True, True, False, False, False, False]
    assert values(spark, urls.identity_form, ["HTTP://A.com/x//?q#f", "http://h", "http://h/", "ftp://h/", "x"]) == ["http://a.com/x?q", "http://h/", "http://h/", "", ""]


def test_dates(spark):
    raw = ["2026-09-17T23:30-05:00", "2026-09-17", "2026-9-7", "20260917", "2026-02-30", "2026-09-17T10:00:00Z[Etc/UTC]", "soon", None]
    day = dt.date(2026, 9, 17)
    assert values(spark, dates.calendar_date, raw) == [day, day, None, None, None, day, None, None]
    mail = values(spark, dates.mail_instant, ["Thu, 17 Sep 2026 10:00:00 GMT", "17 Sep 2026 10:00:00 +0900", "yesterday"])
    assert [m and (m.hour) for m in mail] == [10, 1, None]


def test_temporal_cases(spark):
    period = (dt.date(2026, 9, 7), dt.date(2026, 9, 13))
    cases = [
        ("notice", [("2026-09-07", "NOTICE_PUBLISHED")], "NONE"), ("notice", [("2026-09-06", "NOTICE_PUBLISHED"), ("2026-09-08", "NOTICE_ISSUED")], "OUT_OF_RANGE"),
        ("other", [("2026-09-13T23:59:59-11:00", "ORIGINAL_PUBLICATION")], "NONE"), ("other", [("2026-09-08", "MODIFIED")], "DATE_PROVENANCE_INVALID"),
        ("other", [("2026-09-08", "ORIGINAL_PUBLICATION"), ("2026-09-09", "ORIGINAL_PUBLICATION")], "DATE_CONFLICT"), ("other", [("soon", "ORIGINAL_PUBLICATION")], "DATE_UNPARSEABLE"), ("other", [], "DATE_MISSING"),
    ]
    candidates = spark.createDataFrame([(i, s, *period, None) for i, (s, _, _) in enumerate(cases)], "candidate_id long, source_type string, period_start date, period_end date, discovered string")
    facts = spark.createDataFrame([(i, *f) for i, (_, fs, _) in enumerate(cases) for f in fs], "candidate_id long, raw string, kind string")
    got = {r.candidate_id: r.diagnostic for r in temporal.decide(candidates, facts).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_content_ids(spark):
    import hashlib
    import json

    row = spark.sql("select 'x\"y' as url, cast(null as string) as n, '字' as t").select(ids.content_id("cand_", url=F.col("url"), n=F.col("n"), t=F.col("t")).alias("id")).first()
    plain = json.dumps({"n": None, "t": "字", "url": 'x"y'}, ensure_ascii=False, separators=(",", ":"))
    assert row.id == "cand_" + hashlib.sha256(plain.encode()).hexdigest()


def test_pages():
    page = "<html><head><title>T</title><meta property='article:published_time' content='2026-09-07'></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two<p>three<div role=search>no</div><button>b</button></article><footer>f</footer>"
    status, boundary, title, headline, body, _, found, parts = read_page(page)
    assert (status, boundary, title, headline, body, parts) == ("READY", "article", "T", "Head", "One two three", ["One two", "three"])
    assert found == [{"raw": "2026-09-07", "kind": "ORIGINAL_PUBLICATION", "zone": None}]
    assert read_page("<title>Same</title><main><h1>Same</h1></main>")[0] == read_page("<title>Same</title><main><p>same </p></main>")[0] == "TITLE_ONLY"
    assert read_page(None)[0] == read_page("<nav>x</nav>")[0] == "EMPTY"


@pytest.mark.parametrize(
    ("html", "url", "status", "body"),
    [
        ("<article>a</article><article>b</article>", "", "COLLECTION", ""),
        ("<article>a</article><article></article>", "", "READY", "a"),
        ("<article>a</article><article><a href='/other'>b</a></article>", "http://h/x", "READY", "a"),
        ("<article>a</article><article><a href='/x'>b</a></article>", "http://h/x", "COLLECTION", ""),
        ("<article><div itemprop=articleBody>a</div></article><article>b</article>", "", "READY", "a"),
        ("<main>a</main><main>b</main>", "", "AMBIGUOUS", ""),
        ("<main><ul><li><h2>A</h2>a<li><h2>B</h2>b</ul></main>", "", "COLLECTION", ""),
        ("<main><ul><li>a<li>b</ul></main>", "http://h/x", "READY", "a b"),
        ("<nav>n</nav><main><p>a</main>", "http://h/", "LANDING_PAGE", ""),
        ("<nav>n</nav><p>a", "http://h/search?q=x", "SEARCH_SHELL", ""),
        ("<body><div><h2>A</h2>a</div><div><h2>B</h2>b</div></body>", "", "AMBIGUOUS", ""),
        ("<main><p>a <a href='/y'>in prose</a></p><ul><li><a href='/z'>z</a></li></ul></main>", "http://h/x", "READY", "a in prose"),
        ("<article>a<article>below</article><p>b</p></article>", "", "READY", "a b"),
        ("<main><div role=comment>c</div><p>a</p></main>", "http://h/x", "READY", "a"),
        ("<body><p><a href='/y'>only</a></p></body>", "http://h/x", "LINKS_ONLY", "only"),
        ("<?xml version='1.0'?><rss><channel/></rss>", "", "FEED", ""),
        ("<?xml version='1.0'?><r:RDF xmlns:r='u'><r:Description r:about='x'/></r:RDF>", "", "RDF_GRAPH", ""),
        ("<?xml version='1.0'?><a><b></a>", "", "MALFORMED", ""),
    ],
)
def test_principal_documents(html, url, status, body):
    found = read_page(html, url)
    assert (found[0], found[4]) == (status, body)


def test_deep_pages_and_roles():
    deep = "<div>" * 5000 + "text of the page" + "</div>" * 5000
    assert read_page(f"<body>{deep}</body>", "http://h/x")[0] is not None
    assert read_page("<body><div role='navigation menu'>NAV</div><main>Text here.</main></body>", "http://h/x")[4] == "Text here."
    assert "NAV" not in read_page("<body><main><div role='navigation menu'>NAV</div>Text here.</main></body>", "http://h/x")[4]


def test_dates_of_pages():
    data = '<script type="application/ld+json">{"@graph": [{"url": "http://h/x", "datePublished": "2026-09-07T10:00:00+08:00"}, {"url": "http://h/y", "datePublished": "2026-01-01"}, {"datePublished": "2026-01-02"}]}</script>'
    page = f"<head>{data}</head><article>a<time datetime='2026-09-08' itemprop=dateModified>t</time><time datetime='2026-01-03'>u</time><aside><time pubdate datetime='2026-01-04'>v</time></aside></article>"
    assert [(f["raw"], f["kind"], f["zone"]) for f in read_page(page, "http://h/x")[6]] == [("2026-09-07T10:00:00+08:00", "ORIGINAL_PUBLICATION", "+08:00"), ("2026-09-08", "MODIFIED", None)]


def test_spans_in_segments(spark):
    df = spark.createDataFrame([(["ab", "cde"], 0, 2), (["ab", "cde"], 3, 5), (["ab", "cde"], 1, 4)], "s array<string>, a int, b int")
    got = [r.x and tuple(r.x) for r in df.select(segment_of(F.col("s"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [(0, 0, 2), (1, 0, 2), None]


def test_recipient_keys(spark):
    import hashlib
    import hmac

    got = values(spark, lambda c: ledger.recipient_key(c, b"k"), [" A@x.org ", None])
    assert got == [hmac.new(b"k", b"a@x.org", hashlib.sha256).hexdigest(), None]


FEEDS = {
    "<rss version='2.0'><channel><title>feed</title></channel></rss>": ("SUCCESS_ZERO_RESULTS", None, []),
    "<rss>": ("INVALID_RESPONSE", "MALFORMED", []),
    "no feed": ("INVALID_RESPONSE", "MALFORMED", []),
    "": ("INVALID_RESPONSE", "MALFORMED", []),
    "<feed><channel><item><title>a</title><link>b</link></item></channel></feed>": ("INVALID_RESPONSE", "UNEXPECTED_ROOT", []),
    "<rss><channel><item><title>ok</title></item></channel></rss>": ("INVALID_RESPONSE", "MISSING_LINK", []),
    "<rss><channel><item><title> </title><link>x</link></item></channel></rss>": ("INVALID_RESPONSE", "EMPTY_TITLE", []),
    "<rss><channel><item><title>a</title><link>x</link><source>s</source><source>t</source></item></channel></rss>": ("INVALID_RESPONSE", "REPEATED_SOURCE", []),
    "<rss><channel/><channel/></rss>": ("INVALID_RESPONSE", "CHANNELS", []),
    "<rss/>": ("INVALID_RESPONSE", "CHANNELS", []),
    "<?xml version='1.0'?><!-- c --><rss><channel><item><title>Story</title><link> https://n.example/story?a=1&amp;b </link><source url=' http://p.example '>Publisher</source><pubDate>2026-01-01</pubDate><description>Snippet</description></item></channel></rss>":
        ("SUCCESS_WITH_RESULTS", None, [("Story", " https://n.example/story?a=1&b ", "Publisher", "2026-01-01", "Snippet", "http://p.example")]),
    "<rss><channel><item><title>a</title><link>x</link><description/></item><item><title>b</title><link>y</link></item></channel></rss>":
        ("SUCCESS_WITH_RESULTS", None, [("a", "x", "", "", "", ""), ("b", "y", "", "", "", "")]),
}


def test_feeds(spark):
    df = spark.createDataFrame([*enumerate(FEEDS), (99, None)], "feed_id long, body string")
    state = {r.feed_id: (r.status, r.reason) for r in feeds.feed_documents(df).collect()}
    items: dict = {}
    for r in feeds.feed_items(df).orderBy("feed_id", "ordinal").collect():
        items.setdefault(r.feed_id, []).append((r.title, r.link, r.publisher, r.published, r.snippet, r.publisher_url))
    for i, (body, (status, reason, want)) in enumerate(FEEDS.items()):
        assert (*state[i], items.get(i, [])) == (status, reason, want), body
    assert state[99] == ("INVALID_RESPONSE", "MALFORMED")


def test_amp_pages(spark):
    base = "https://www.h.example/a/b/c"
    refs = {"/x": "https://www.h.example/x", "../y?utm_source=1&q=2": "https://www.h.example/a/y?q=2", "./z": "https://www.h.example/a/b/z", "../../../w": "https://www.h.example/w", "//h.example/v": "https://h.example/v", "https://other.example/z": "", "c": "", "?q": "https://www.h.example/a/b/c?q"}
    pages = [f"<html amp><link rel=canonical href='{r}'>" for r in refs] + [None, "<html amp>", "<html lang=amped><link rel=canonical href='/x'>", "<html ⚡ x><LINK href=\"/x\" rel='canonical'><link rel=canonical href='/y'>", "<html ⚡>" + " " * 20_000 + "<link rel=canonical href='/x'>"]
    assert values(spark, lambda c: urls.amp_canonical(c, F.lit(base)), pages) == [*refs.values(), "", "", "", "", ""]


def test_facts_and_places(spark):
    df = spark.createDataFrame([(" a ", None, {"k": "v", "b": "w"}), (" ", "", None), (None, "x", {})], "p string, q string, c map<string, string>")
    got = [r.x for r in df.select(text.stated_facts(F.col("c"), p=F.col("p"), q=F.col("q")).alias("x")).collect()]
    assert got == [{"p": " a ", "source_claims": '{"b":"w","k":"v"}'}, {}, {"q": "x"}]
    generic = F.array(F.lit("city"), F.lit("area"))
    assert values(spark, lambda c: text.all_generic(text.places_listed(c), generic), ["City and Area", "City, Line 1", "", "1市與11區1"]) == [True, False, False, False]
    assert values(spark, text.places_listed, ["1市與11區1, A1"]) == [["1市", "11區1", "A1"]]
    days = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 7)), (dt.date(2024, 12, 30), dt.date(2025, 1, 5))], "a date, b date")
    assert [r.x for r in days.select(text.period_display(F.col("a"), F.col("b")).alias("x")).collect()] == ["2024/01/01 - 01/07", "2024/12/30 - 2025/01/05"]


def test_key_faults(spark):
    """Repeated keys, keys without a parent, both at once, null keys (which no parent has), and parents without a child; no join."""
    child = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,)], "key long")
    found = constraints.key_faults(child, spark.createDataFrame([(1,), (2,), (2,), (9,), (None,)], "key long"), "key")
    assert sorted((r.key or 0, r.fault, r.n) for r in found.collect()) == [(0, "NO_PARENT", 1), (1, "REPEATED", 2), (3, "NO_PARENT", 2), (3, "REPEATED", 2)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
