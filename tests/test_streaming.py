"""Streams of several batches against tables: stateful deliveries, late rows, sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidentia.streaming import deliveries, ledger, weekly

START = dt.datetime(2024, 1, 1)
TRANSITIONS = "recipient_key string, seq long, new_state string, claim_id string, ts timestamp"


def history(seed: int, n: int = 400) -> list[tuple]:
    """Transitions in the order of time; one recipient has a third of them, some fall silent after a claim."""
    rng, at, rows = random.Random(seed), START, []
    for seq in range(n):
        at += dt.timedelta(minutes=rng.randrange(1, 90))
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(12)}" if seq < n // 2 else f"l{rng.randrange(12)}"
        rows.append((key, seq, rng.choice(("ATTEMPTED", "ATTEMPTED", "SENT", "NOT_SENT", "LOST", None)) if key != "hot" else rng.choice(("ATTEMPTED", "NOT_SENT")), rng.choice(("c1", "c2", None)), at))
    return rows


def brute(rows: list[tuple]) -> dict:
    last = max(r[4] for r in rows)
    found: dict = {}
    day = dt.timedelta(hours=24)
    for key, _, new, claim, at in sorted(rows, key=lambda r: r[1]):
        state, own, since, legal, refused = found.get(key, (None, None, None, 0, 0))
        if state == "ATTEMPTED" and at - since >= day:
            state = "RELEASED"
        claims = new == "ATTEMPTED" and state in (None, "NOT_SENT", "RELEASED")
        ends = new in ("SENT", "NOT_SENT", "RELEASED") and state == "ATTEMPTED" and claim is not None and own == claim
        if claims or ends:
            state, own, since, legal = new, claim, at if claims else since, legal + 1
        else:
            refused += 1
        found[key] = (state, own, since, legal, refused)
    return {k: ("RELEASED" if s == "ATTEMPTED" and last - since >= day else s, own, legal, refused) for k, (s, own, since, legal, refused) in found.items()}


def states(df) -> dict:
    rows = df.collect()
    assert len({r.recipient_key for r in rows}) == len(rows)
    return {r.recipient_key: (r.state, r.claim_id, r.legal, r.refused) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_of_several_batches_is_the_fold(spark, tmp_path, seed):
    rows = history(seed)
    table = spark.createDataFrame(rows, TRANSITIONS)
    assert states(ledger.fold(table.repartition(5), at="ts", until=F.lit(rows[-1][4]))) == brute(rows)
    for k in range(4):  # a file is a batch
        spark.createDataFrame(rows[100 * k : 100 * k + 100], TRANSITIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TRANSITIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert states(deliveries.run_stream(spark, stream)) == brute(rows)


def test_fold_of_odd_rows(spark):
    empty = spark.createDataFrame([], TRANSITIONS)
    assert ledger.fold(empty).count() == 0
    rows = [(None, 1, "ATTEMPTED", "c", START), (None, 2, "SENT", "c", START), ("a", 1, "SENT", "c", START), ("b", 1, "ATTEMPTED", None, START), ("b", 2, "SENT", None, START)]
    found = {r.recipient_key: (r.state, r.legal, r.refused) for r in ledger.fold(spark.createDataFrame(rows, TRANSITIONS)).collect()}
    assert found == {None: ("SENT", 2, 0), "a": (None, 0, 1), "b": ("ATTEMPTED", 1, 1)}


EVENTS = "ts timestamp, user_id long, event_type string"


def batches(spark, folder: str, *parts: list[tuple]):
    """A stream that reads one part after the other."""
    import os
    import time

    for k, part in enumerate(parts):
        spark.createDataFrame([(START + dt.timedelta(minutes=m), u, "view") for m, u in part], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/part{k}")
        for name in os.listdir(f"{folder}/part{k}"):  # files are taken by their age
            if name.endswith(".parquet"):
                os.makedirs(f"{folder}/in", exist_ok=True)
                os.rename(f"{folder}/part{k}/{name}", f"{folder}/in/{k}-{name}")
                stamp = time.time() - 1000 + 10 * k
                os.utime(f"{folder}/in/{k}-{name}", (stamp, stamp))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_late_rows(spark, tmp_path):
    """A row whose windows are still open counts though others are later; one whose windows have closed does not."""
    # the first batch puts the watermark at 200 - 60 minutes; the second closes windows by it, and from then on they are too late
    parts = ([(30, 1), (200, 1)], [(150, 2)], [(30, 2), (150, 3)], [(600, 1)])
    found = weekly.appended(spark, weekly.sliding(batches(spark, str(tmp_path), *parts)))
    got = {int((r.window_start - START).total_seconds() // 60): r.n for r in found.collect()}
    # minute 150 is in windows from 60 to 180 and from 120 to 240; minute 30 came too late for its own
    assert got == {-60: 1, 0: 1, 60: 2, 120: 3, 180: 1}
    table = weekly.sliding(spark.createDataFrame([(START + dt.timedelta(minutes=m), u, "view") for p in parts for m, u in p], EVENTS))
    assert {int((r.window_start - START).total_seconds() // 60): r.n for r in table.collect()}[0] == 2


def test_sessions_grow_and_close(spark, tmp_path):
    """Sessions of a key join over batches while they are open; a late row inside the watermark bridges two."""
    parts = ([(0, 1), (50, 1), (0, 2)], [(25, 1), (70, 1)], [(500, 3)])
    found = weekly.appended(spark, weekly.sessions(batches(spark, str(tmp_path), *parts), "user_id"))
    minutes = lambda t: int((t - START).total_seconds() // 60)
    assert {(r.user_id, minutes(r.session_start), minutes(r.session_end), r.n) for r in found.collect()} == {(1, 0, 100, 4), (2, 0, 30, 1)}
