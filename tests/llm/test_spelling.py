"""Spelling variants against brute force."""

import random
import zlib

import numpy as np
import pytest

from evidentia.llm import spelling
from evidentia.llm.spelling import WaveletTree, spelling_variants, vocabulary

from . import helpers as H

LETTERS = "abéüzÀ"


def edits(word: str, letters: str) -> set[str]:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in letters for k in (0, 1) if i + k <= len(word)}
    return out - {word}


def brute(n: dict[str, int]) -> dict[str, tuple]:
    letters = "".join({c for w in n for c in w})
    near = {w: [x for x in edits(w, letters) if x in n] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def check(spark, n: dict[str, int]) -> None:
    got = H.by_id(spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)), "word")
    assert {w: (r.form, r.root, r.n, r.n_near, r.form_n) for w, r in got.items()} == brute(n)


def dense(seed: int, size: int) -> dict[str, int]:
    rng = random.Random(seed)
    return {"".join(rng.choice(LETTERS[: rng.choice((2, 6))]) for _ in range(rng.randrange(5, 9))): rng.choice((3, 4, 6, 12, 30)) for _ in range(size)}


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_words(spark, seed):
    check(spark, dense(seed, 400))


def test_divided_blocks(spark, monkeypatch):
    """Words that begin alike are divided by ranges of the edit's place, down to single places."""
    monkeypatch.setattr(spelling, "BLOCK", 40)
    monkeypatch.setattr(spelling, "WORDS", 30)
    monkeypatch.setattr(spelling, "QUERIES", 16)
    words = dense(3, 150)
    check(spark, words | {"prefix" + w: k for w, k in words.items()} | {w + "ending": k for w, k in words.items()})


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    chain = {"aaaaa" + "b" * k: 3 * 2**k for k in range(12)}
    check(spark, chain | {long: 3, long + "a": 6, long[:2000] + "z" + long[2001:]: 9, long[1:]: 40, "Ästen": 3, "ästen": 5})


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 17, 64):
        values = rng.permutation(m)
        left, low = rng.integers(0, m, 50), rng.integers(0, m, 50)
        right, high = left + rng.integers(0, m, 50) % (m - left + 1), low + rng.integers(0, m + 1, 50)
        query, value = WaveletTree(values).report(left, right, low, high)
        want = sorted((q, int(v)) for q in range(50) for v in values[left[q] : right[q]] if low[q] <= v < high[q])
        assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == want


def test_vocabulary(spark):
    rows = [(k, "Straße, STRAßE straße ÄPFEL xäpfelx abc×def don't " + "A" * 300, "en", "s", 0) for k in range(200)]
    rows += [(None, "Straße nulls nulls nulls", None, None, None), (201, None, None, None, None), (202, "", None, None, 0), (5, "repeated repeated", None, None, 0), (5, "repeated", None, None, 0)]
    want: dict = {}
    for i, text, *_ in rows:
        for run in runs_of(text or ""):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
            if len(word) >= 5:
                want[word] = want.get(word, 0) + 1
    got = {r.word: r.n for r in vocabulary(H.docs(spark, rows)).collect()}
    assert got == {w: k for w, k in want.items() if k >= 3}


def runs_of(text: str) -> list[str]:
    import re

    return re.findall("[A-Za-zÀ-ÿ]+", text.translate({k: k + 32 for k in range(65, 91)}))


def test_odd_tables(spark):
    assert spelling_variants(vocabulary(H.docs(spark, []))).count() == 0
    rows = [("words", 3, 1), ("wards", 9, 1), (None, 5, 1), ("lonely", None, 1)]
    got = spelling_variants(spark.createDataFrame(rows, "word string, n long, size int")).collect()
    assert sorted((r.word, r.form, r.n_near) for r in got) == [("wards", None, 1), ("words", "wards", 1)]
