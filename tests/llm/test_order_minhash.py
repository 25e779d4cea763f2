"""Order MinHash against a plain version, and against the edit distance."""

import hashlib
import random
from collections import Counter

import numpy as np

from evidentia.llm import order_minhash as O

from . import helpers as H


def points(text):
    return np.array([ord(c) for c in text], dtype=np.uint32)


def plain_mix(x):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> shift)) * times % 2**64
    return x


def plain_fingerprint(text):
    """Every k-mer summed up on its own, numbered by a dictionary, chosen by a sort: Python integers only."""
    times = 0x9E3779B97F4A7C15
    k = min(len(text), O.KMER)
    grams = [plain_mix(sum((ord(c) + 1) * 0xD6E8FEB86659FD93 * times**j for j, c in enumerate(text[i : i + k])) % 2**64) for i in range(len(text) - k + 1)] if text else [0]
    seen, values = Counter(), []
    for gram in grams:
        values.append(plain_mix((gram + seen[gram] * times) % 2**64) >> 32)
        seen[gram] += 1
    out = []
    for m in range(O.SAMPLES):
        hashed = [(v ^ int(O._FLIP[m, 0])) * int(O._TIMES[m, 0]) % 2**32 for v in values]
        found = int(O._SALT[m])
        for at in sorted(sorted(range(len(grams)), key=hashed.__getitem__)[: O.TUPLE]):
            found = plain_mix((found * times + grams[at]) % 2**64)
        out.append(found >> 48)
    return out


def test_fingerprint_is_the_plain_one():
    rng = random.Random(9)
    texts = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaa" * 20, "été 東京 𝒳𝒴 " * 30, "abcabcabd" * 50]
    texts += ["".join(rng.choice("ab \n") for _ in range(n)) for n in (9, 60, 1500)] + ["".join(chr(rng.randrange(32, 0xD000)) for _ in range(700))]
    for text in texts:
        assert O.fingerprint(points(text)).tolist() == plain_fingerprint(text), text[:20]


def test_numbering():
    text = "abcabcabcxyz" * 3
    grams = np.array([hash(text[i : i + 3]) & 0xFFFFFFFFFFFF0000 for i in range(len(text) - 2)], dtype=np.uint64)
    at, values = O.numbered(grams)
    assert sorted(at) == list(range(len(grams)))
    assert len(set(values.tolist())) == len(grams)  # every occurrence has a value of its own
    again, same = O.numbered(grams[:10])
    first = {(int(grams[p]), [int(g) for g in grams[:p]].count(int(grams[p]))): int(v) for p, v in zip(at, values)}
    assert all(first[(int(grams[p]), [int(g) for g in grams[:p]].count(int(grams[p])))] == v for p, v in zip(again, same))


def test_selection():
    values = np.random.default_rng(1).integers(0, 2**32, 5000, dtype=np.uint64).astype(np.uint32)
    for n in (1, 2, 3, 5000):
        got = O.selected(values[:n])
        for m in (0, 17, O.SAMPLES - 1):
            hashed = (values[:n] ^ O._FLIP[m]) * O._TIMES[m]
            assert list(got[m]) == list(np.argsort(hashed, kind="stable")[: min(O.TUPLE, n)])


def test_likeness_follows_edits_and_order():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    few = list(text)
    for _ in range(10):
        few[rng.randrange(len(few))] = "z"
    swapped = text[2000:] + text[:2000]
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a = O.fingerprint(points(text))
    near, moved, far = (O.likeness(a, O.fingerprint(points(x))) for x in ("".join(few), swapped, other))
    assert near > 0.75 > moved > 0.3 > far  # a set sketch would hold the swapped text for the same
    assert O.likeness(a, O.fingerprint(points(text))) == 1


def test_query_rows(spark):
    rows = H.corpus(8)
    got = H.by_id(O.compare_with_next(H.docs(spark, rows)))
    order = sorted(rows, key=lambda r: -r[0])
    assert got.keys() == {r[0] for r in rows}
    prints = {}
    for own, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after, r = own[1] or "", following[1] or "", got[own[0]]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == np.array(plain_fingerprint(text), dtype="<u2").tobytes().hex()
        assert r.edited_fingerprint == np.array(plain_fingerprint(new), dtype="<u2").tobytes().hex()
        assert r.near_edited == O.likeness(O.fingerprint(points(text)), O.fingerprint(points(new)))
        assert r.near_next == O.likeness(O.fingerprint(points(text)), O.fingerprint(points(after)))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_odd_tables(spark):
    assert O.compare_with_next(H.docs(spark, [])).count() == 0
    one = O.compare_with_next(H.docs(spark, [(1, "abcd", None, None, None)])).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)] and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    rows = [(7, "x", None, None, None), (7, "x", None, None, None), (None, None, None, None, None), (None, "y", None, None, None)]
    assert sorted((r.doc_id or 0, r.n_chars) for r in O.compare_with_next(H.docs(spark, rows)).collect()) == [(0, 0), (0, 1), (7, 1), (7, 1)]
