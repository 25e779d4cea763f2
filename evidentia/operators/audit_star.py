"""The audit of a run: a row for each candidate with what became of it at every stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import quoted, shared_dir

#: The stages in their order, each with the state that lets a candidate go on.
STAGES = (
    ("evidence", "READY"), ("scope", "IN_SCOPE"), ("temporal", "VALID"), ("identity", "GROUPED"), ("category", "ASSIGNED"),
    ("taxonomy", "EVALUATED"), ("reportability", "REPORTABLE"), ("metadata", "POPULATED"), ("writer", "WRITTEN"),
)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder that is divided and sorted by key: joins of such tables on the key move nothing."""
    name = f"audit_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def once(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows, which must hold a key once only; the check reads the table in the division it has."""
    twice = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} has {key} {twice[0][0]} more than once")
    return rows


def star(candidates: DataFrame, stages: dict[str, DataFrame], gaps: DataFrame, key: str = "candidate_id", buckets: int = 16) -> DataFrame:
    """candidates with the state and reason of every stage, and the technical gap of each.

    stages: a table of key, state, reason for each name of STAGES, a candidate at most once in each; gaps: key, stage,
    reason, at most one for a candidate and stage (of more the least reason counts). All are written as
    tables divided by the key alike, and their left joins share that division: no exchange stands between them.
    """
    known = {n for n, _ in STAGES}
    if set(stages) != known:
        raise ValueError(f"stages must be {sorted(known)}")
    noted = gaps.groupBy(key, "stage").agg(F.min("reason").alias("reason"))
    pivoted = noted.groupBy(key).agg(*[F.min(F.when(F.col("stage") == n, F.col("reason"))).alias(f"gap_{n}") for n, _ in STAGES])
    rows = once(bucketed(candidates, key, buckets), key, "candidates").join(bucketed(pivoted, key, buckets), key, "left")
    for name, _ in STAGES:
        side = stages[name].select(key, F.col("state").alias(f"state_{name}"), F.col("reason").alias(f"reason_{name}"))
        rows = rows.join(once(bucketed(side, key, buckets), key, name), key, "left")
    return rows


def selection(audited: DataFrame, key: str = "candidate_id") -> DataFrame:
    """key, terminal_stage, terminal_state, reason and states (JSON of stage and state) for each candidate of a star.

    A candidate ends at the first stage that didn't let it go on: with that stage's state and reason, with
    TECHNICAL_GAP where the stage left a gap instead, or with NOT_REACHED where there is neither. One that passed all
    stages ends as REPORTED at the last."""
    ends = []
    for name, good in STAGES:
        state, gap = F.col(f"state_{name}"), F.col(f"gap_{name}")
        end = lambda s, r, n=name: F.struct(F.lit(n).alias("stage"), s.alias("state"), r.alias("reason"))
        ends.append(F.when(gap.isNotNull(), end(F.lit("TECHNICAL_GAP"), gap)).when(state.isNull(), end(F.lit("NOT_REACHED"), F.lit(None).cast("string"))).when(state != good, end(state, F.col(f"reason_{name}"))))
    last = F.struct(F.lit(STAGES[-1][0]).alias("stage"), F.lit("REPORTED").alias("state"), F.lit(None).cast("string").alias("reason"))
    states = F.to_json(F.struct(*[F.col(f"state_{n}").alias(n) for n, _ in STAGES]))
    return audited.withColumn("__end", F.coalesce(*ends, last)).select(F.col(quoted(key)), F.col("__end.stage").alias("terminal_stage"), F.col("__end.state").alias("terminal_state"), F.col("__end.reason").alias("reason"), states.alias("states"))
