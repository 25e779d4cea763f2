"""The trie of conversations against brute force, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from evidentia.llm import prefix_trie as P
from evidentia.llm import queries
from evidentia.llm.prefix_trie import prefix_trie

from . import helpers as H

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> dict:
    own: dict = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members: dict = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(H.WORD.findall(node[-1][1].encode())) if node else 0) + sum(saved[x] for x in below)
    return {
        (m[0], len(node)): (
            members[node[:-1]][0] if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in members.items()
    }


def found(df) -> dict:
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def talks(seed: int, n: int = 130) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), n):
        kind = rng.randrange(4)
        length = rng.choice((1, 2, 3, 5, 9))
        for t in range(length):
            text = rng.choice(("hello there", "how are you today", "", None, f"only {c}", " spaced\tout\n words ")) if kind else f"always the same {t}"
            rows.append((c, t if rng.random() < 0.95 or t else None, rng.choice(("user", "assistant", None)) if kind > 1 else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed):
    rows = talks(seed)
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_parts_and_pieces(spark, monkeypatch):
    """Families handed on in parts, ids in pieces, and long shared conversations."""
    monkeypatch.setattr(P, "HELD", 3)
    monkeypatch.setattr(P, "PIECE_BITS", 2)
    rows = talks(4) + [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(40 if c % 3 else 37)]
    assert found(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).count() == 0
    rows = [(None, 1, "user", "nobody"), (19, 0, None, None), (19, 0, None, None), (7, None, "user", None)]
    clashing = spark.createDataFrame([(*r, 5, "x", None) for r in rows], SCHEMA + ", depth int, a string, family string")
    assert found(prefix_trie(clashing)) == brute(rows[1:])


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    answer = con.execute(queries.ORACLES["op12_prefix_trie"])
    names = [c[0] for c in answer.description]
    want = {(r["conv_id"], r["depth"]): r for r in (dict(zip(names, x, strict=True)) for x in answer.fetchall())}
    assert {(r.conv_id, r.depth): r.asDict() for r in queries.op12_prefix_trie(spark, "/root/testdata/sf0.001").collect()} == want
