"""The state machine of deliveries as a stream: a state for each recipient, and timers that release old claims."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.tables import shared_dir
from .ledger import RELEASE_HOURS, Entry

_STATE = "state string, claim_id string, claimed_at long, legal long, refused long"
_ROW = "recipient_key string, state string, claim_id string, legal long, refused long"


class Deliveries(StatefulProcessor):
    """Takes a recipient's transitions in the order of seq. An open claim has a timer at the end of RELEASE_HOURS."""

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", _STATE)

    def _read(self) -> Entry:
        return Entry(*self.entry.get()) if self.entry.exists() else Entry()

    def _row(self, key: tuple, entry: Entry) -> Row:
        return Row(recipient_key=key[0], state=entry.state, claim_id=entry.claim_id, legal=entry.legal, refused=entry.refused)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entry = self._read()
        for row in sorted(rows, key=lambda r: r.seq):
            entry.take(row.new_state, row.claim_id, row.at)
        self.entry.update(astuple(entry))
        if entry.state == "ATTEMPTED":
            self.handle.registerTimer(entry.claimed_at // 1000 + RELEASE_HOURS * 3_600_000)
        yield self._row(key, entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self._read()
        # a timer may be that of an earlier claim, which has ended since
        if entry.expire(timerValues.getCurrentWatermarkInMs() * 1000):
            self.entry.update(astuple(entry))
        yield self._row(key, entry)

    def close(self) -> None:
        pass


def stream_states(transitions: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """States of recipients as a stream of changes: recipient_key, state, claim_id, legal, refused.

    transitions is a stream: recipient_key, seq, new_state, claim_id, ts (event time). Rows of a key have to
    come in the order of seq from batch to batch; a row later than the watermark (ts less delay) still counts.
    Old claims are released when the watermark passes their time, also where nothing more comes for their key.
    """
    rows = transitions.withWatermark("ts", delay).select("recipient_key", "seq", "new_state", "claim_id", F.unix_micros("ts").alias("at"), "ts")
    return rows.groupBy("recipient_key").transformWithState(statefulProcessor=Deliveries(), outputStructType=_ROW, outputMode="Update", timeMode="EventTime")


def run_stream(spark: SparkSession, transitions: DataFrame) -> DataFrame:
    """Runs stream_states over what is there and returns the last state of each recipient. A batch's changes are
    one folder, which a repeated batch overwrites."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    where = f"{shared_dir(spark)}/deliveries-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        # a key may change twice in a batch: by its rows, then by a timer, which only ever adds a release
        batch.withColumn("step", F.when(F.col("state") == "RELEASED", 1).otherwise(0)).write.mode("overwrite").parquet(f"{where}/out/epoch={epoch}")

    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream_states(transitions).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(keep).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    found = spark.read.schema(f"{_ROW}, step int, epoch int").parquet(f"{where}/out")
    last = F.max_by(F.struct("state", "claim_id", "legal", "refused"), F.struct("epoch", "legal", "refused", "step")).alias("last")
    return found.groupBy("recipient_key").agg(last).select("recipient_key", "last.*")
