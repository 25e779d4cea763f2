"""Results and typed gaps of a run in one pass: what fails leaves a gap of its subject, or ends the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: How many aborted subjects an error names.
NAMED = 5


@dataclass(frozen=True)
class Stage:
    """A step that every subject goes through until one fails it."""

    name: str
    #: The reason why a subject fails here, or null.
    failure: Column
    #: Failures that are not the subject's but the run's.
    aborts: Column | None = None


class RunAborted(RuntimeError):
    """A failure of the run itself: counts by stage and reason, and a few of the subjects it met."""

    def __init__(self, counts: dict[tuple[str, str], int], subjects: list):
        self.counts, self.subjects = counts, subjects
        told = ", ".join(f"{n} x {stage}/{reason}" for (stage, reason), n in sorted(counts.items()))
        super().__init__(f"the run is aborted: {told}; first subjects {subjects}")


def outcomes(subjects: DataFrame, key: str, stages: Sequence[Stage]) -> DataFrame:
    """subjects with stage and reason of the first stage that each fails (null for those that pass all) and abort.

    One projection: no stage shuffles or reads again. Reasons are texts; a null is no failure."""
    first = F.coalesce(*[
        F.when(s.failure.isNotNull(), F.struct(F.lit(s.name).alias("stage"), s.failure.cast("string").alias("reason"), F.coalesce(s.aborts if s.aborts is not None else F.lit(False), F.lit(False)).alias("abort")))
        for s in stages
    ])
    rows = subjects.withColumn("__gap", first)
    return rows.select(*subjects.columns, F.col("__gap.stage").alias("stage"), F.col("__gap.reason").alias("reason"), F.coalesce("__gap.abort", F.lit(False)).alias("abort"))


def split(subjects: DataFrame, key: str, stages: Sequence[Stage]) -> tuple[DataFrame, DataFrame]:
    """(results, gaps): subjects that pass all stages, and key, stage, reason of the others. Both are read from one
    table that is written once, so that neither side runs the stages again and together they cover all subjects.

    Raises RunAborted if any subject meets a failure of the run; then there are no results.
    Subjects may repeat or have a null key; each row is in one of the two. No subjects give two empty tables."""
    done, seen = written(outcomes(subjects, key, stages), aborted=F.count_if(F.col("abort")))
    if seen["aborted"]:
        met = done.where("abort")
        counts = {(r.stage, r.reason): r.n for r in met.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n")).limit(100).collect()}
        raise RunAborted(counts, [r[0] for r in met.select(key).orderBy(key).limit(NAMED).collect()])
    return done.where("stage is null").drop("stage", "reason", "abort"), done.where("stage is not null").select(key, "stage", "reason")


def coverage_faults(subjects: DataFrame, results: DataFrame, gaps: DataFrame, key: str) -> DataFrame:
    """Keys that results and gaps hold not exactly as often as subjects do: key, given, found. Sound runs have none."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    found = count(results.select(key).unionByName(gaps.select(key)), "found")
    both = count(subjects, "given").withColumnRenamed(key, "__key").join(found, F.col("__key").eqNullSafe(F.col(key)), "full_outer")
    both = both.select(F.coalesce("__key", key).alias(key), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("given", "found")])
    return both.where("given <> found")
