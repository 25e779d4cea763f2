"""Formatting reads back exactly, whatever the texts hold."""

import random

from evidentia.llm.chat_format import escape, format_conversations, under_mask, unescape
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["### ", "###", "#", "</turn>", "\n", "\n</turn>\n", "\\", "Assistant: ", ": ", "%", "ok", "é😀", " ", "### User: hi\n</turn>\n"]


def expected(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}


def test_round_trip(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(8)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "User", "a: b\n%3A", "</turn>", "", None]), rng.choice([text(), text(), None])) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (99, None, "user", "first"), (None, 0, "assistant", "x" * 100_000)]
    found = format_conversations(spark.createDataFrame(rows, SCHEMA).withColumns({"t": F.lit(1), "formatted": F.lit(2)}))
    got = found.withColumn("learned", under_mask(F.col("formatted"), F.col("loss_spans"))).collect()
    want = expected(rows)
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    for r in got:
        assert r.learned == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        for t in r.turns:
            raw = r.formatted[t.start : t.start + t.length]
            assert raw.replace("\\### ", "### ").replace("\\</turn>", "</turn>") == t.text


def test_escape_is_reversible(spark):
    texts = [(x,) for x in ["\\### ", "\\\\</turn>", "#### ", "### ### ", "</turn></turn>\\", ""]]
    df = spark.createDataFrame(texts, "x string")
    assert df.where(unescape(escape(F.col("x"))) != F.col("x")).count() == 0
    assert df.where(F.regexp_like(escape(F.col("x")), F.lit(r"(?<!\\)(### |</turn>)"))).count() == 0


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
