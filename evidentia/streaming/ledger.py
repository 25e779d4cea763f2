"""Deliveries as a keyed state machine: ATTEMPTED, then SENT, NOT_SENT or RELEASED."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States from which a new attempt may start, and states in which an attempt ends.
IDLE, ENDS = ("NOT_SENT", "RELEASED"), ("SENT", "NOT_SENT", "RELEASED")
#: Hours after which an open claim may be released, and seconds a claim may be sent in.
RELEASE_HOURS, SEND_SECONDS = 24, 3600


@dataclass
class Entry:
    """A recipient's place in the state machine."""

    state: str | None = None
    claim_id: str | None = None
    #: Event time of the open claim in microseconds, where events have one.
    claimed_at: int | None = None
    legal: int = 0
    refused: int = 0

    def expire(self, now: int | None) -> bool:
        """Releases an open claim that is old enough."""
        old = self.state == "ATTEMPTED" and None not in (now, self.claimed_at) and now - self.claimed_at >= RELEASE_HOURS * 3_600_000_000
        if old:
            self.state = "RELEASED"
        return old

    def take(self, new_state: str | None, claim_id: str | None, at: int | None = None) -> None:
        """A claim (ATTEMPTED) is legal where nothing is in flight and nothing was sent; it ends with its own claim id only."""
        self.expire(at)
        if new_state == "ATTEMPTED":
            good = self.state is None or self.state in IDLE
        else:
            good = new_state in ENDS and self.state == "ATTEMPTED" and claim_id is not None and self.claim_id == claim_id
        if good:
            self.state, self.claim_id, self.legal = new_state, claim_id, self.legal + 1
            if new_state == "ATTEMPTED":
                self.claimed_at = at
        else:
            self.refused += 1


_STATES = "recipient_key string, state string, claim_id string, legal long, refused long"


def _folding():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry, started = None, Entry(), False

        def row() -> tuple:
            return key, entry.state, entry.claim_id, entry.legal, entry.refused

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("recipient_key", "new_state", "claim_id", "at", "until")]
            for k, new_state, claim_id, at, until in zip(*columns, strict=True):
                if not started or k != key:
                    if started:
                        entry.expire(last)
                        done.append(row())
                    key, entry, started = k, Entry(), True
                entry.take(new_state, claim_id, at)
                last = until
            yield pa.RecordBatch.from_pylist([dict(zip(("recipient_key", "state", "claim_id", "legal", "refused"), r, strict=True)) for r in done], _ARROW)
        if started:
            entry.expire(last)
            yield pa.RecordBatch.from_pylist([dict(zip(("recipient_key", "state", "claim_id", "legal", "refused"), row(), strict=True))], _ARROW)

    return run


_ARROW = pa.schema([("recipient_key", pa.string()), ("state", pa.string()), ("claim_id", pa.string()), ("legal", pa.int64()), ("refused", pa.int64())])


def fold(transitions: DataFrame, at: str | None = None, until: Column | None = None) -> DataFrame:
    """Last legal state per key: recipient_key, state, claim_id, legal, refused. Refused transitions change nothing and are counted.

    transitions: recipient_key, seq, new_state, claim_id. A key's rows pass through a task in the order of seq, as a
    stream of which it holds one state; keys are never gathered into a row or a group. With at (the column
    of event time) an open claim is released once RELEASE_HOURS have passed at a later row of its key, or at the time `until`.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    none = F.lit(None).cast("long")
    rows = transitions.select(
        F.col("recipient_key").cast("string").alias("recipient_key"), "seq", "new_state", F.col("claim_id").cast("string").alias("claim_id"),
        (micros(F.col(at)) if at else none).alias("at"), (none if until is None else micros(until)).alias("until"),
    )
    ordered = rows.repartition("recipient_key").sortWithinPartitions("recipient_key", "seq")
    return ordered.select("recipient_key", "new_state", "claim_id", "at", "until").mapInArrow(_folding(), _STATES)


def roll_up(outcomes: DataFrame, group: str) -> DataFrame:
    """Outcome of a delivery from what this run did for its recipients (outcome: SENT, ALREADY_SENT or anything
    else): SENT if all have it and one got it now, DUPLICATE if all had it before, else FAILED."""
    counts = outcomes.groupBy(group).agg(
        F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("outcome") == "SENT").alias("sent"), F.count_if(F.col("outcome") == "ALREADY_SENT").alias("already_sent")
    )
    status = F.when(F.col("sent") + F.col("already_sent") < F.col("recipients"), "FAILED").when(F.col("sent") > 0, "SENT").otherwise("DUPLICATE")
    return counts.withColumn("status", status)


def record(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The ledger after this run's outcomes: an outcome is written only where the entry is still the run's own
    open claim. ledger: recipient_key, state, claim_id; outcomes: recipient_key, claim_id, new_state."""
    told = outcomes.select("recipient_key", F.col("claim_id").alias("__claim"), "new_state")
    rows = ledger.join(told, "recipient_key", "left")
    mine = F.coalesce((F.col("state") == "ATTEMPTED") & (F.col("claim_id") == F.col("__claim")) & F.col("new_state").isin(*ENDS), F.lit(False))
    return rows.select("recipient_key", F.when(mine, F.col("new_state")).otherwise(F.col("state")).alias("state"), "claim_id", mine.alias("written"))


def release(ledger: DataFrame, group: str, now: Column) -> DataFrame:
    """Releases the open claims of a group if all of them are old enough, else none of them: ledger with state and released.
    ledger: group, recipient_key, state, claimed_at."""
    open_ = F.col("state") == "ATTEMPTED"
    aged = F.timestamp_diff("HOUR", F.col("claimed_at"), now) >= RELEASE_HOURS
    young = ledger.where(open_ & ~F.coalesce(aged, F.lit(False))).select(group).distinct().withColumn("__young", F.lit(True))
    rows = ledger.join(young, group, "left").withColumn("released", open_ & F.col("__young").isNull())
    return rows.withColumn("state", F.when(F.col("released"), "RELEASED").otherwise(F.col("state"))).drop("__young")


def claim_lines(claims: DataFrame, observed: DataFrame, now: Column) -> DataFrame:
    """recipient_key and line of each attempted claim; what was observed since takes the place of its age."""
    rows = claims.where("state = 'ATTEMPTED'").select("recipient_key", "claimed_at").join(observed.select("recipient_key", "observation"), "recipient_key", "full_outer")
    age = F.concat(F.timestamp_diff("HOUR", F.col("claimed_at"), now).cast("string"), F.lit("h"))
    return rows.select("recipient_key", F.concat_ws(" ", "recipient_key", F.coalesce("observation", age, F.lit("UNKNOWN"))).alias("line"))


def numbered_log(rows: DataFrame, run: str, order: str) -> DataFrame:
    """rows of each run with a sequence number from 1, as an append-only log."""
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(order)))


ENTRY = "recipient_key string, state string, claim_id string"


def serialised(ledger: DataFrame) -> DataFrame:
    return ledger.select(F.to_json(F.struct("claim_id", "recipient_key", "state"), {"ignoreNullFields": "false"}).alias("entry"))


def parsed(entries: DataFrame) -> DataFrame:
    """Entries as rows; one with other fields, or without one of them, is not valid."""
    names = F.array_sort(F.json_object_keys("entry"))
    good = F.coalesce(names == F.array(F.lit("claim_id"), F.lit("recipient_key"), F.lit("state")), F.lit(False))
    return entries.select(F.from_json("entry", ENTRY).alias("e"), good.alias("valid")).select("e.*", "valid")


def recipient_key(address: Column, secret: bytes) -> Column:
    """Hex HMAC-SHA256 of the address in lower case, so that a ledger holds no addresses."""

    @F.pandas_udf("string")
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret, v.strip().lower().encode(), hashlib.sha256).hexdigest())

    return keyed(address)


def recipients(listed: Column) -> Column:
    """Distinct well-formed addresses of a list with commas, semicolons or newlines, in their order."""
    parts = F.transform(F.split(listed, r"[,;\n]"), lambda p: F.lower(F.trim(p)))
    return F.array_distinct(F.filter(parts, lambda p: F.regexp_like(p, F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))))


def last_states(transitions: DataFrame) -> DataFrame:
    """The latest row of each key, legal or not."""
    latest = F.row_number().over(Window.partitionBy("recipient_key").orderBy(F.desc("seq")))
    return transitions.withColumn("__n", latest).where("__n = 1").drop("__n")


def attempts_within(calls: DataFrame, key: str, order: str, retryable: Column, most: int = 2) -> DataFrame:
    """Recorded attempts that a bounded retry would make: the first, and further ones while those before could be
    retried, at most `most` of each key."""
    along = Window.partitionBy(key).orderBy(order)
    rows = calls.withColumn("attempt", F.row_number().over(along))
    rows = rows.withColumn("__stopped", F.coalesce(F.max((~retryable).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.where((F.col("attempt") <= most) & (F.col("__stopped") == 0)).drop("__stopped")


def within_limit(calls: DataFrame, kind: str, order: str, limit: int) -> DataFrame:
    """Calls of each kind up to the limit, in order, with used (how many were made)."""
    rows = calls.withColumn("used", F.row_number().over(Window.partitionBy(kind).orderBy(order)))
    return rows.where(F.col("used") <= limit)
