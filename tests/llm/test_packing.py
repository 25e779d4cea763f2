"""Each token in exactly one piece, pieces gapless in full windows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evidentia.llm import packing

from . import helpers as H

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("unit", [1 << 22, 1 << 12])
def test_every_token_once(spark, unit, monkeypatch):
    monkeypatch.setattr(packing, "UNIT", unit)
    rows = H.corpus(6, 120) + [(9_000, "It's <|endoftext|>x 12km　ideo nbsp é İ ΣσΣ. ́alone\x85next\x1cfs a\0b \0 Ā \0\0c", "en", "s", 0)]
    tokenizer = Tokenizer.from_file(PATH)
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(H.docs(spark, rows), PATH).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], dtype="<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.context, r.step_id))
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        assert [s for s, _ in sorted(found)] == list(np.cumsum([0] + [n for _, n in sorted(found)])[:-1])
        assert sum(n for _, n in found) == len(ids[i])
    for found in sequences.values():
        at = 0
        for offset, length, context, _ in sorted(found):
            assert offset == at
            at += length
        assert at == context <= 2048 and at & (at - 1) == 0
        assert len({x[2:] for x in found}) == 1


def test_steps_are_balanced():
    rng = random.Random(2)
    sequences = list(packing.pack(np.array([rng.randrange(1, 6000) for _ in range(3000)])))
    groups = packing.step_groups(sequences)
    by = defaultdict(list)
    for (size, pieces), g in zip(sequences, groups, strict=True):
        by[int(g)].append((size, sum(n * n for *_, n in pieces)))
    full = [sum(c for _, c in v) for v in by.values() if v[0][0] == 2048]
    assert max(full) < 1.15 * min(full)
    assert all(len({s for s, _ in v}) == 1 for v in by.values())


def test_odd_tables(spark):
    assert packing.pack_documents(H.docs(spark, []), PATH).count() == 0
    rows = [(None, None, None, None, None), (4, "", None, None, None), (4, "", None, None, None)]
    got = packing.pack_documents(H.docs(spark, rows), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (4, 1), (4, 1)]


def test_word_tokens_are_the_tokenizers():
    rng = random.Random(3)
    letters = "abcXYZéÉüÜßçÀÿñ'’.,!?-_1²٣ſKÅıİσΣ́\0"
    texts = ["".join(rng.choice(letters + "  ") for _ in range(60)) for _ in range(400)]
    tokenizer, words = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for _ in range(2):  # the second time from memory
        ids, bounds = words.encode(data, offsets)
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
