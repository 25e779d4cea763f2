"""Language identification by held-out accuracy; url verdicts by cases."""

import math
import random
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import language_id as L
from evidentia.llm import url_filter as U
from evidentia.llm import url_vocabulary as V
from pyspark.sql import functions as F

from . import helpers as H

WORDS = {"en": ["the", "house", "thing", "with", "shown", "river"], "fr": ["été", "maison", "avec", "choses", "où", "rivière"], "de": ["Haus", "schön", "über", "nicht", "Fluß", "Straße"]}


def rows_of(seed=1, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 30))), lang, "s", 0))
    return out


def test_held_out_accuracy(spark):
    rows = rows_of()
    odd = [(900, None, "en", "s", 0), (901, "12 34 !?", "en", "s", 0), (902, "", None, None, None), (903, "the house " * 60_000, None, None, None)]
    docs = H.docs(spark, rows + odd)
    got = H.by_id(L.identify(docs, L.fit(docs.where(~L.held_out(F.col("doc_id")))), held_out=L.held_out(F.col("doc_id"))))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    apart = [r for r in rows if got[r[0]].held_out]
    assert len(apart) > 50 and sum(got[r[0]].lang_pred == r[2] for r in apart) >= 0.98 * len(apart)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())


def plain_grams(text):
    """The n-grams of a text as strings, one by one."""
    low = text.lower()
    return [low[i : i + k] for k in L.ORDERS for i in range(len(low) - k + 1)]


def bucket(gram):
    return int(dict(L.buckets(np.array([ord(c) for c in gram], dtype=np.uint32)))[len(gram)][0])


@pytest.mark.parametrize("piece", [1 << 17, 64])
def test_scores_are_naive_bayes(spark, piece, monkeypatch):
    """Counts, smoothing, priors and posteriors against dictionaries of strings, with texts in one piece and in many."""
    monkeypatch.setattr(L, "PIECE", piece)
    rows = rows_of(2, 40) + [(77, "Größe und ÉTÉ où 東京 " * 20, "de", "s", 0)]
    docs = H.docs(spark, rows)
    model = L.fit(docs)
    assert model.langs == sorted(WORDS)
    counts = {lang: Counter(bucket(g) for _, text, x, *_ in rows if x == lang for g in plain_grams(text)) for lang in model.langs}
    share = Counter(r[2] for r in rows)
    log_p = {}
    for k, lang in enumerate(model.langs):
        total = sum(counts[lang].values()) + 0.5 * L.BUCKETS
        log_p[lang] = lambda b, c=counts[lang], t=total: math.log((c[b] + 0.5) / t)
        assert all(math.isclose(model.matrix[k, b], log_p[lang](b)) for b in range(0, L.BUCKETS, 97))
        assert math.isclose(model.priors[k], math.log(share[lang] / len(rows)))
    got = H.by_id(L.identify(docs, model))
    for i, text, *_ in [*rows[:5], rows[-1]]:
        grams = [bucket(g) for g in plain_grams(text)]
        total = np.array([sum(map(log_p[x], grams)) for x in model.langs])
        judged = total + model.priors
        best = int(judged.argmax())
        assert got[i].lang_pred == model.langs[best] and got[i].grams == len(grams)
        assert math.isclose(got[i].score, 1 / np.exp(judged - judged.max()).sum(), rel_tol=1e-3, abs_tol=1e-6)
        assert math.isclose(got[i].likelihood, total[best] / len(grams), rel_tol=1e-5)


def test_many_labels(spark):
    """More labels than a task holds at once; equal scores go to the first by name."""
    rows = [(i, f"word{i} " * 5, f"l{i:04}", "s", 0) for i in range(700)]
    docs = H.docs(spark, rows)
    got = H.by_id(L.identify(docs, L.fit(docs)))
    assert sum(got[i].lang_pred == f"l{i:04}" for i in range(700)) > 650
    same = H.docs(spark, [(1, "same", "b", "s", 0), (2, "same", "a", "s", 0), (2, "same", None, "s", 0), (None, "same", None, None, None)])
    assert {r.lang_pred for r in L.identify(same, L.fit(same)).collect()} == {"a"}


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    one = rng.normal(-8, 2, L.BUCKETS)
    table = np.array([one, one + rng.normal(0, 0.01, L.BUCKETS)], dtype=np.float32)
    score = L._score(["x", "y"], np.zeros(2), types.SimpleNamespace(value=table))
    last = lambda texts: list(score(iter([pa.RecordBatch.from_pydict({"text": texts})])))[0].column("score")[-1].as_py()
    assert last(["the house of words " * 12_000, "a short text"]) == last(["a short text"])


def test_nothing_learned(spark):
    docs = H.docs(spark, [(1, "words", None, None, 0)])
    assert [(r.lang_pred, r.score) for r in L.identify(docs, L.fit(docs)).collect()] == [("und", 0.0)]
    empty = H.docs(spark, [])
    assert L.identify(empty, L.fit(empty)).count() == 0


def test_urls(spark):
    rules = (U.Rule("net/", False), U.Rule("example.net/en/", True), U.Rule("example.com/de/", False), U.Rule("org/fr/", True))
    cases = {
        "http://A.Example.NET/en/x?casino": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "https://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://x.org/fr/casino": ("x.org", "/fr/casino", "org/fr/", "allow"),
        "https://x.org/casino": ("x.org", "/casino", None, "block"),
        "https://x.org/casinos": ("x.org", "/casinos", None, "allow"),
        "https://x.com/cheap": ("x.com", "/cheap", None, "allow"),
        "https://x.com/cheap-pills": ("x.com", "/cheap-pills", None, "block"),
        "https://x.com/cheap-cheap": ("x.com", "/cheap-cheap", None, "allow"),
        "x.com/xxx": ("", "", None, "block"),
        "http://h?q://z/a": ("h", "", None, "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://net#/": ("net", "", None, "allow"),
        "http://net/#/": ("net", "/", "net/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(cases)], "page_id long, url string, html string, host int")
    got = H.by_id(U.judge_urls(df, rules), "page_id")
    for i, (url, want) in enumerate(cases.items()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, url


def test_many_rules_are_joined(spark, monkeypatch):
    rules = [U.Rule(f"h{i}.example.org/{'x/' * (i % 3)}", i % 2 == 0) for i in range(60)] + [U.Rule("org/", False), U.Rule("example.org/x/", True)]
    urls = [f"http://a.h{i}.example.org/{'x/' * (i % 4)}y" for i in range(60)] * 2 + ["http://b.org/", "http://b.com/x", "", None, "http://example.org/x/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    inline = U.judge_urls(df, rules).collect()
    monkeypatch.setattr(U, "INLINE_RULES", 5)
    assert sorted(map(str, U.judge_urls(df, rules).collect())) == sorted(map(str, inline))


def test_odd_pages(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rows = [(1, "http://x.com/", 5), (1, "http://x.com/", 6), (None, "http://y.com/", 7), (None, None, None)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, `rule.x` int")).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}


VOCABULARY = {
    "http://www.pornhub.com/": "block",  # a strict term and a link
    "https://freecasino.com": "block",
    "https://x.com/casinos": "block",
    "https://c4s1no365.com/x": "block",  # digits for letters, and digits beside
    "https://free-bets.example.com": "block",
    "https://freebets.example.com": "block",
    "https://winwin.com/wins": "allow",  # forms of one term are one hit
    "https://web.de/billige-kredite": "block",
    "https://x.es/préstamos/gratis": "block",
    "http://essex.ac.uk/": "allow",
    "https://therapist.org/free": "allow",
    "https://casinox.com": "allow",  # the rest of the run is no piece
    "https://freedom.org/winner": "allow",
    "https://x.com/" + "casino" * 2000: "block",
    "https://x.com/" + "a" * 20_000 + "casino": "allow",
}


def test_vocabulary(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(VOCABULARY)], "page_id long, url string")
    got = H.by_id(U.judge_urls(df, vocabulary=V.standard()), "page_id")
    for i, (url, want) in enumerate(VOCABULARY.items()):
        assert got[i].verdict == want, url[:60]
    assert got[6].soft_terms == ["win"]


def test_vocabulary_against_all_divisions():
    """Compounds against a search through all ways to divide a run."""
    known = V.weighted([("free", "en", False), ("bet", "en", False), ("casino", "en", True)], links=("hub", "my", "e"))
    pieces = [*known.forms, *known.links, *"0123456789"]
    terms = known.automaton()

    def divisions(run):
        if not run:
            yield []
        for p in pieces:
            if run.startswith(p):
                yield from ([p, *rest] for rest in divisions(run[len(p) :]))

    rng = np.random.default_rng(5)
    words = ["free", "bet", "bets", "casino", "cas1no", "hub", "my", "e", "7", "x", "be", "fre"]
    for _ in range(400):
        runs = ["".join(rng.choice(words, rng.integers(1, 5))) for _ in range(rng.integers(1, 4))]
        used = {known.forms[p] for run in runs for d in divisions(run) for p in d if p in known.forms}
        want = sorted(t for t, strict in used if strict), sorted(t for t, strict in used if not strict)
        assert U.hits("-".join(runs), terms, compounds=True) == want


def test_vocabulary_of_a_table(spark, monkeypatch):
    rows = [(" Bad ", "en", True), ("odd", None, None), (None, "en", True), ("", "en", True), ("bad", "en", True)]
    terms = spark.createDataFrame(rows, "term string, language string, strict boolean")
    found = V.from_table(terms)
    assert found.forms["bads"] == found.forms["b4d"] == ("bad", True) and found.forms["0dd"] == ("odd", False) and "odds" not in found.forms
    assert V.from_table(terms.limit(0)).forms == {}
    monkeypatch.setattr(V, "MOST_FORMS", 60)
    with pytest.raises(ValueError):
        V.from_table(terms)


def test_a_listed_term_goes_before_a_derived_one():
    assert V.weighted([("bet", "en", True), ("bets", "en", False)]).forms["bets"] == ("bets", False)
