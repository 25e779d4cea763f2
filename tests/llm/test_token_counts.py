"""Token counts against the libraries themselves, and the cache behind them."""

import glob

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from evidentia.llm import token_counts
from evidentia.llm.token_counts import count_tokens, tokenizer_version

from . import helpers as H

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPECIAL = "before <|endoftext|> after <s> </s> \u0000 é \r\n"


def library(path: str):
    if path == BYTES:
        model = Tokenizer.from_file(path)
        return lambda text: len(model.encode(text, add_special_tokens=False).ids)
    model = SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


@pytest.mark.parametrize("path", [BYTES, PIECES])
def test_counts(spark, path):
    rows = [*H.corpus(3), (9_001, SPECIAL, None, None, None), (9_002, "word " * 100_000, None, None, None)]
    count = library(path)
    got = H.by_id(count_tokens(H.docs(spark, rows), path, limit=30))
    want = {i: (len((t or "").encode()), count(t or "")) for i, t, *_ in rows}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 30) for r in got.values())


def test_cache(spark, tmp_path, monkeypatch):
    """Each distinct text is encoded once, whatever run asks for it; another version of a tokenizer has its own counts."""
    cache = str(tmp_path / "cache")
    rows = H.corpus(4)
    texts = {t or "" for _, t, *_ in rows}

    def stored(path=BYTES):
        return spark.read.parquet(f"{cache}/tokenizer={tokenizer_version(path)}").count()

    first = H.by_id(count_tokens(H.docs(spark, rows), BYTES, cache=cache))
    assert stored() == len(texts)
    files = set(glob.glob(f"{cache}/*/*.parquet"))
    again = H.by_id(count_tokens(H.docs(spark, [*rows, (-1, "a new text", None, None, None), (-2, "a new text", None, None, None)]), BYTES, cache=cache))
    assert stored() == len(texts) + 1 and files <= set(glob.glob(f"{cache}/*/*.parquet"))
    assert {i: r for i, r in again.items() if i >= 0} == first
    count_tokens(H.docs(spark, rows[:20]), PIECES, cache=cache).collect()
    assert stored() == len(texts) + 1 and stored(PIECES) == len({t or "" for _, t, *_ in rows[:20]})
    # beyond the bound of a broadcast, and a text that two runs have stored
    monkeypatch.setattr(token_counts, "small", lambda df, rows, width: df)
    folder = f"{cache}/tokenizer={tokenizer_version(BYTES)}"
    spark.read.parquet(folder).limit(5).write.mode("append").parquet(folder)
    assert H.by_id(count_tokens(H.docs(spark, rows), BYTES, cache=cache)) == first


def test_odd_tables(spark):
    assert count_tokens(H.docs(spark, []), BYTES).count() == 0
    rows = [(7, "twice", None), (7, "twice", None), (None, "twice", None), (None, None, None), (8, "", 3)]
    clashing = spark.createDataFrame([(*r, b"x", 1) for r in rows], "doc_id long, text string, n_tokens int, digest binary, times int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in count_tokens(clashing, BYTES).collect())
    n = library(BYTES)("twice")
    assert got == [(-1, 0), (-1, n), (7, n), (7, n), (8, 0)]
    with pytest.raises(ValueError):
        count_tokens(clashing, "vocabulary.txt")
