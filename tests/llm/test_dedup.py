"""Near, exact and substring deduplication against brute force."""

import pytest

from evidentia.llm import _repeats, near_dedup
from evidentia.llm.exact_dedup import exact_duplicates
from evidentia.llm.near_dedup import near_duplicates
from evidentia.llm.substring_dedup import remove_repeated_bytes, remove_repeated_passages

from . import helpers as H


@pytest.mark.parametrize("seed", [1, 2])
def test_near(spark, seed):
    rows = H.corpus(seed)
    got = H.by_id(near_duplicates(H.docs(spark, rows), shingle=2))
    want = H.brute_near(rows, 2)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_in_small_blocks(spark, monkeypatch):
    """Large buckets of close but unlinked documents are compared block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(40):  # neighbours are alike, distant ones are not
        text = base[:]
        for j in range(2 * k, 2 * k + 20):
            text[j % 120] = f"x{j % 120}-{(j + 2 * k) // 120}"
        rows.append((k, " ".join(text), "en", "s", 0))
    rows += [(100 + k, r[1], "en", "s", 0) for k, r in enumerate(rows[::3])]
    got = H.by_id(near_duplicates(H.docs(spark, rows), shingle=2))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == H.brute_near(rows, 2)


def test_near_around_the_limit_of_fine_sketches(spark):
    """Pairs of small, of large and of small and large sets meet by sketches of the same kind."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(k, " ".join(words[(at := 97 * k % 211) : at + 1000 + 40 * (k % 14)]), "en", "s", 0) for k in range(30)]
    rows += [(100 + k, " ".join(f"v{k % 5}-{i}" for i in range(1050 + 37 * k)), "en", "s", 0) for k in range(15)]
    got = H.by_id(near_duplicates(H.docs(spark, rows), shingle=2))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == H.brute_near(rows, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = H.corpus(seed)
    got = H.by_id(remove_repeated_bytes(H.docs(spark, rows), length=200))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == H.brute_bytes(rows, 200)


@pytest.mark.parametrize("group", [8_000, 2])
def test_passages(spark, group, monkeypatch):
    monkeypatch.setattr(_repeats, "GROUP", group)
    rows = H.corpus(3)
    got = H.by_id(remove_repeated_passages(H.docs(spark, rows), words=20))
    assert {i: (r.n_words, r.n_removed, bytes(r.kept)) for i, r in got.items()} == H.brute_passages(rows, 20)


def test_bytes_in_shuffled_windows(spark, monkeypatch):
    monkeypatch.setattr(_repeats, "GROUP", 2)
    monkeypatch.setattr(_repeats, "PIECE", 1 << 10)
    monkeypatch.setattr(_repeats, "SORTED", 1 << 12)
    rows = H.corpus(4)
    got = H.by_id(remove_repeated_bytes(H.docs(spark, rows), length=200))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == H.brute_bytes(rows, 200)


def test_exact(spark):
    rows = H.corpus(5)
    got = H.by_id(exact_duplicates(H.docs(spark, rows)))
    groups: dict = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {i: (r.keep_id, r.group_size, r.kept) for i, r in got.items()} == want


@pytest.mark.parametrize("operator", [near_duplicates, exact_duplicates, remove_repeated_bytes, remove_repeated_passages])
def test_odd_tables(spark, operator):
    empty = H.docs(spark, [])
    assert operator(empty).count() == 0
    long = "repeated words in a row " * 40
    rows = [(7, long, "en", "s", 0), (7, long, "en", "s", 0), (None, long, None, None, None), (None, None, None, None, None), (9, None, None, None, None)]
    clashing = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], H.DOCS + ", rid long, kept int, root int")
    found = operator(clashing).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in rows)
