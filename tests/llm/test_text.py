"""Hashes against plain arithmetic, and against texts that break polynomials modulo 2**64."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import _text as T
from evidentia.llm import exact_dedup, language_id, near_dedup, packing
from evidentia.llm.substring_dedup import remove_repeated_bytes, remove_repeated_passages

from . import helpers as H


def thue_morse(n: int, flip: bool = False) -> str:
    """A word and its complement: their polynomials agree modulo 2**64 at every odd base, from about 1,024 letters on."""
    return "".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(n))


@pytest.mark.parametrize("kind", [np.uint8, np.uint64])
def test_prefixes(kind, monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 3000).astype(np.uint8) if kind is np.uint8 else rng.integers(0, 2**64, 3000, dtype=np.uint64)
    whole = T.prefix_hash(values)
    total = 0
    for i, x in enumerate(values.tolist()):
        total = (total + (x + (kind is np.uint8)) * pow(T._BASE, i, T.PRIME)) % T.PRIME
        assert int(whole[i + 1]) == total
    monkeypatch.setattr(T, "_CHUNK", 100)
    assert (T.prefix_hash(values) == whole).all()
    own = T.range_hash(whole, np.array([7]), np.array([90]))
    assert own == T.range_hash(T.prefix_hash(values[7:90]), np.array([0]), np.array([83]))


def test_long_words_are_hashed_in_parts():
    data = np.frombuffer(b"x " + b"abc" * 1000 + b" y", dtype=np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    assert (T.long_word_hashes(data, starts, ends, piece=100) == T.long_word_hashes(data, starts, ends)).all()
    assert len(set(T.word_hashes(np.frombuffer(b"a a\0 a\0\0 aaaaaaaa aaaaaaaa\0 aaaaaaaaa", dtype=np.uint8), np.array([0, 2, 5, 9, 18, 28]), np.array([1, 4, 8, 17, 27, 37])).tolist())) == 6


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_words_stay_apart(spark, n):
    one, other = thue_morse(n), thue_morse(n, flip=True)
    data = np.frombuffer(f"{one} {other}".encode(), dtype=np.uint8)
    starts, ends, _ = T.words(data, np.array([0, len(data)]))
    assert len(set(T.word_hashes(data, starts, ends).tolist())) == 2
    filler = [f"w{i}" for i in range(19)]
    rows = [(1, one, "en", "s", 0), (2, other, "en", "s", 0), (3, " ".join([*filler, one]), "en", "s", 0), (4, " ".join([*filler, other]), "en", "s", 0)]
    docs = H.docs(spark, rows)
    got = H.by_id(near_dedup.near_duplicates(docs, shingle=2))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == H.brute_near(rows, 2)
    got = H.by_id(remove_repeated_passages(docs, words=20))
    assert {i: (r.n_words, r.n_removed, bytes(r.kept)) for i, r in got.items()} == H.brute_passages(rows, 20)
    for length in (200, 1000, n, n + 20):
        got = H.by_id(remove_repeated_bytes(docs, length=length))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == H.brute_bytes(rows, length)


@pytest.mark.parametrize("length", [1500, 2000])
def test_long_windows(spark, length):
    rng = np.random.default_rng(length)
    text = "".join(rng.choice(list("abcdefg "), 4000))
    rows = [(1, text, "en", "s", 0), (2, "x" + text[:2500] + "y", "en", "s", 0), (3, "z" * 3500, "en", "s", 0), (4, text[1000:], "en", "s", 0)]
    got = H.by_id(remove_repeated_bytes(H.docs(spark, rows), length=length))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items()} == H.brute_bytes(rows, length)


def test_no_window_beyond_the_longest(spark):
    with pytest.raises(ValueError):
        remove_repeated_bytes(H.docs(spark, []), length=1 << 20)


def test_very_long_texts(spark):
    """Longer than every slice in which texts are handled."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(5000)]
    long = " ".join(rng.choice(words, 700_000))  # 4.9 MB
    near = long[: len(long) // 2] + " another word " + long[len(long) // 2 :]
    docs = H.docs(spark, [(1, long, "en", "s", 0), (2, near, "en", "s", 0), (3, long, None, None, 0), (4, "short", "en", "s", 0)])
    got = H.by_id(near_dedup.near_duplicates(docs, shingle=2))
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert got[1].n_shingles == len(H.shingles(long, 2))
    got = H.by_id(remove_repeated_passages(docs, words=20))
    assert got[1].n_removed < 100 and got[3].n_removed == got[3].n_words and got[2].n_removed == got[2].n_words - 2
    got = H.by_id(remove_repeated_bytes(docs, length=200))
    assert got[3].n_removed == got[3].n_bytes and got[2].n_removed == got[2].n_bytes - 13 and got[2].n_spans == 2
    got = H.by_id(exact_dedup.exact_duplicates(docs))
    assert [got[i].keep_id for i in (1, 2, 3, 4)] == [3, 2, 3, 4]
    sizes = {}
    import public_tokenizers

    for r in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        assert sizes[r.doc_id] <= r.doc_tokens
    assert sizes[1] == sizes[3]
    model = language_id.fit(docs)
    assert {r.lang_pred for r in language_id.identify(docs, model).collect()} == {"en"}


def test_dotted_names(spark):
    rows = [(1, "some words here", "en", "s", 0, "x"), (2, "some words here", "en", "s", 0, "y")]
    docs = spark.createDataFrame(rows, H.DOCS + ", `a.b``c` string")
    carried = {"q.r": F.col("`a.b``c`")}
    for found in (
        exact_dedup.exact_duplicates(docs, **carried),
        language_id.identify(docs, language_id.fit(docs), **carried),
    ):
        assert sorted(r["q.r"] for r in found.collect()) == ["x", "y"]
