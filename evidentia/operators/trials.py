"""Acceptance trials: answers as JSON, leaks of the expected answer, seals over rounds, requests cut to size."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_DECODER = json.JSONDecoder()


def _object_at(text: str, at: int) -> tuple[dict | None, int]:
    try:
        value, end = _DECODER.raw_decode(text, at)
    except (ValueError, RecursionError):
        return None, -1
    return (value, end) if isinstance(value, dict) else (None, -1)


def _doubled(content: str) -> dict | None:
    text = content.strip()
    whole, end = _object_at(text, 0)
    if not whole or end == len(text):
        return None
    starts = (i for i in range(end, len(text)) if text[i] == "{")
    last = next((value for value, stop in (_object_at(text, i) for i in starts) if stop == len(text)), None)
    return whole if last == whole else None


def _answer(content) -> tuple[str | None, str]:
    if not isinstance(content, str):
        return None, "NO_CONTENT"
    try:
        value, how = json.loads(content), "PLAIN"
    except (ValueError, RecursionError):
        value, how = _doubled(content), "RECOVERED"
        if value is None:
            return None, "INVALID"
    return (json.dumps(value, ensure_ascii=False, separators=(",", ":")), how) if isinstance(value, dict) else (None, "NOT_AN_OBJECT")


@F.pandas_udf(StructType().add("answer", StringType()).add("status", StringType()))
def answer(content: pd.Series) -> pd.DataFrame:
    """The object that an answer holds, as JSON, and how it was read: PLAIN, RECOVERED (a complete object, anything,
    and an equal object again), INVALID, NOT_AN_OBJECT or NO_CONTENT."""
    return pd.DataFrame([_answer(c) for c in content], columns=["answer", "status"])


def json_keys(value: Column) -> Column:
    """The distinct keys of valid JSON at any depth, as they are written there."""
    strings = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), 0)
    return F.array_distinct(F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.regexp_replace(s, r'^"|"\s*:$', "")))


def leaks(requests: DataFrame, secret_keys: Sequence[str]) -> DataFrame:
    """Requests that show what only the judge may know: case_id, leak (KEY, CASE_ID or FILE_NAME), one row for each.
    requests: case_id, payload (JSON), file_name (may be null or empty)."""
    found = F.array(
        F.when(F.arrays_overlap(json_keys(F.col("payload")), F.array(*[F.lit(k) for k in secret_keys])), "KEY"),
        F.when(F.contains("payload", F.col("case_id").cast("string")), "CASE_ID"),
        F.when((F.col("file_name") != "") & F.contains("payload", "file_name"), "FILE_NAME"),
    )
    return requests.select("case_id", F.explode(F.array_compact(found)).alias("leak"))


def sealed(rounds: DataFrame, batch: str, planned: int, expected: Mapping[str, object], deployment: str, acceptance: str) -> DataFrame:
    """A verdict for each batch of rounds: batch, verdict, blocker, failed_rounds (sorted round numbers).

    rounds: batch, round, acceptance, configuration, deployment_status, deployment, and the columns of
    expected. BLOCKED names the first of: not exactly the planned rounds; numbers other than 1 to planned;
    another acceptance version or differing configurations; deployments that differ or weren't observed.
    Otherwise rounds that differ from expected make FINDINGS, else PASS.
    """
    good = F.lit(True)
    for column, value in expected.items():
        good &= F.coalesce(F.col(column) == F.lit(value), F.lit(False))
    one = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    all_are = lambda c, v: F.bool_and(F.coalesce(F.col(c) == v, F.lit(False)))
    seen = rounds.groupBy(batch).agg(
        (F.count(F.lit(1)) == planned).alias("complete"),
        ((F.min("round") == 1) & (F.max("round") == planned) & (F.count_distinct("round") == planned)).alias("numbered"),
        (all_are("acceptance", acceptance) & one("configuration")).alias("frozen"),
        (all_are("deployment_status", deployment) & one("deployment")).alias("observed"),
        F.sort_array(F.collect_set(F.when(~good & F.col("round").between(1, planned), F.col("round")))).alias("failed"),
    )
    blocker = F.when(~F.col("complete"), "ROUNDS_MISSING_OR_EXTRA").when(~F.coalesce("numbered", F.lit(False)), "ROUND_NUMBERS")
    blocker = blocker.when(~F.coalesce("frozen", F.lit(False)), "CONFIGURATION_NOT_FROZEN").when(~F.coalesce("observed", F.lit(False)), "DEPLOYMENT_NOT_FROZEN")
    open_ = blocker.isNull()
    verdict = F.when(~open_, "BLOCKED").when(F.size("failed") > 0, "FINDINGS").otherwise("PASS")
    return seen.select(batch, verdict.alias("verdict"), blocker.alias("blocker"), F.when(open_, F.col("failed")).otherwise(F.array().cast(dict(seen.dtypes)["failed"])).alias("failed_rounds"))


def _cut(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, used = None, 0, 0
        for batch in batches:
            numbers = []
            for k, size in zip(batch.column("run").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if number == 0 or k != key:
                    key, number, used = k, 1, 0
                elif used + size > limit:
                    number, used = number + 1, 0
                used += size
                numbers.append(number)
            yield batch.append_column("cut", pa.array(numbers, pa.int64()))

    return run


def cut_requests(records: DataFrame, limit: int) -> DataFrame:
    """Consecutive requests of a run that doesn't fit as a whole: run, record, request (from 1).

    records: run (not null), record, position, size. Records follow one another by position and record; one that
    would pass the limit opens the next request. Requests of a single record are left out, and not counted.
    A run is read in order by one task, which holds a number and a sum and no rows.
    """
    ordered = records.select("run", "position", "record", F.col("size").cast("long").alias("size")).repartition("run").sortWithinPartitions("run", "position", "record")
    kinds = dict(ordered.dtypes)
    cut = ordered.mapInArrow(_cut(limit), ", ".join([*[f"{c} {kinds[c]}" for c in ordered.columns], "cut long"]))
    numbered = cut.groupBy("run", "cut").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    numbered = numbered.select("run", "cut", F.row_number().over(Window.partitionBy("run").orderBy("cut")).cast("long").alias("request"))
    return cut.join(numbered, ["run", "cut"]).select("run", "record", "request")
