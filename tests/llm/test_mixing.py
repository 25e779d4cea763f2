"""Raking against a plain loop, and sampling by its probabilities."""

import random
from collections import defaultdict

import pytest

from evidentia.llm import mixing

from . import helpers as H

COLUMNS = ["source", "lang", "topic"]


def plain(cells, targets, sweeps=400):
    weight = dict(cells)
    for _ in range(sweeps):
        for k in range(3):
            sums = defaultdict(float)
            for key, w in weight.items():
                sums[key[k]] += w
            weight = {key: w * targets[k].get(key[k], 0.0) / sums[key[k]] if sums[key[k]] else 0.0 for key, w in weight.items()}
    return weight


@pytest.mark.parametrize("local", [100_000, 0])
def test_rake(spark, local, monkeypatch):
    monkeypatch.setattr(mixing, "LOCAL_CELLS", local)
    rng = random.Random(1)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): float(rng.randrange(1, 1000)) for a in range(4) for b in range(3) for c in range(2)}
    del cells["s0", "l0", "t0"]
    targets = {"source": {"s0": 1, "s1": 1, "s2": 2, "s3": 4}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, COLUMNS, 0.5, targets).collect()}
    topics = defaultdict(float)
    for k, v in cells.items():
        topics[k[2]] += v
    total = sum(v**0.5 for v in topics.values())
    want = plain(cells, [{k: v / 8 for k, v in targets["source"].items()}, targets["lang"], {k: v**0.5 / total for k, v in topics.items()}])
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_mix(spark):
    rows = [*H.corpus(2, 200), (10_000, "x", "xx", "srcz", 1)]
    got = H.by_id(mixing.mix(H.docs(spark, rows), fraction=0.3))
    assert got.keys() == {r[0] for r in rows}
    assert all(0 <= r.probability <= 1 for r in got.values())
    cells = defaultdict(set)
    for r in got.values():
        cells[r.source, r.lang, r.topic].add(r.probability)
        assert r.tokens == max(1, -(-len((next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()) // 4))
    assert all(len(p) == 1 for p in cells.values())
    again = H.by_id(mixing.mix(H.docs(spark, rows[::-1]), fraction=0.3))
    assert {i: r.kept for i, r in again.items()} == {i: r.kept for i, r in got.items()}


def test_draws_follow_probabilities(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'some words' as text", "'s' as source", "'en' as lang", "1L as tokens", "2 as cell")
    found = mixing.mix(df, fraction=0.3)
    share = found.where("kept").count() / 20_000
    assert abs(share - 0.3) < 0.02


def test_odd_tables(spark):
    assert mixing.mix(H.docs(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", None, "s", 0)]
    assert mixing.mix(H.docs(spark, rows)).count() == 3


def test_full_cells_are_made_up_for(spark):
    sizes = {("s0", "en", "a"): 4000, ("s0", "en", "b"): 100, ("s0", "de", "a"): 900, ("s1", "en", "a"): 60, ("s1", "de", "b"): 500, ("s1", "de", "a"): 440}
    rows = [(1000 * k + i, "x", *cell[:2], cell[2], size // 20) for k, (cell, size) in enumerate(sizes.items()) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kind string, size long")
    targets = {"source": {"s0": 0.7, "s1": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"a": 0.5, "b": 0.5}}
    found = mixing.mix(df, fraction=0.5, topic=df.kind, tokens=df["size"], targets=targets).collect()
    want = {"source": targets["source"], "lang": targets["lang"], "topic": {"a": 0.8, "b": 0.2}}  # all 600 tokens of b are a fifth of the 3,000 wanted
    for column, shares in want.items():
        for value, share in shares.items():
            assert abs(sum(r.probability * r.tokens for r in found if r[column] == value) / 3000 - share) < 1e-6, (column, value)
    assert all(r.probability <= 1 for r in found)


def test_marginals_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 4.0)], "source string, lang string, tokens double")
    targets = {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.8, "y": 0.2}}
    raked = mixing.rake(cells, ["source", "lang"], 0.5, targets)
    got = {(r["column"], r["value"]): (round(r.natural, 9), round(r.reached, 9)) for r in mixing.marginals(raked, ["source", "lang"]).collect()}
    assert got == {("source", "a"): (0.5, 0.7), ("source", "b"): (0.5, 0.3), ("lang", "x"): (0.875, 0.8), ("lang", "y"): (0.125, 0.2)}


def test_contradictions_are_reported(spark):
    cells = spark.createDataFrame([("a", "x", 50.0), ("b", "y", 50.0)], "source string, lang string, tokens double")
    with pytest.warns(UserWarning, match="missed"):
        mixing.rake(cells, ["source", "lang"], 0.5, {"source": {"a": 0.7, "b": 0.3}, "lang": {"x": 0.2, "y": 0.8}})
