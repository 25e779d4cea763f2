"""Integrity of a whole run: every stage answers for what the stage before let through, once and in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running

#: Stages by candidate in their order, with the state that lets a candidate through; and the stage whose
#: gaps may repeat for a subject if their classes differ.
CHAIN = (("evidence", "READY"), ("scope", "IN_SCOPE"), ("temporal", "VALID"), ("identity", "GROUPED"))
CLASSED = ("identity",)


def run_faults(candidates: DataFrame, results: DataFrame, gaps: DataFrame, chain: Sequence[tuple[str, str]] = CHAIN, blocked: bool = False) -> DataFrame:
    """stage, candidate_id, fault of everything that breaks the integrity of a run; a sound run has no rows.

    candidates: candidate_id, position (their order, total). results: stage, candidate_id, state, position of all
    stages. gaps: stage, subject_id, failure_class. The inputs of a stage are the candidates, or the results of the stage
    before with the state that lets them through. Faults of a stage and candidate:

    REPEATED_RESULT, REPEATED_GAP (of one class in the stages of CLASSED), NO_RESULT (an input with neither result nor
    gap), RESULT_DESPITE_GAP, NO_INPUT (a result without an input), UNKNOWN_SUBJECT (a gap without an input),
    OUT_OF_ORDER (a result that stands at another place among the results than its input among the inputs that
    have one), UNKNOWN_STAGE. Faults of the run, without a candidate: NO_PREDECESSOR (a stage has results, the one
    before has neither results nor gaps, though candidates went in), BLOCKED (results although the search was blocked), REPEATED_CANDIDATE.

    All stages are one table that is aggregated by stage and candidate, in one exchange. Null ids are an id of their own.
    """
    names = [n for n, _ in chain]
    before = dict(zip(names[1:], chain, strict=False))
    follows = F.lit(None).cast("string")
    for name, (earlier, state) in before.items():
        follows = F.when((F.col("stage") == earlier) & (F.col("state") == state), name).otherwise(follows)
    kind = dict(candidates.dtypes)["candidate_id"]
    row = lambda df, stage, what, position: df.select(stage.alias("stage"), F.col("candidate_id").cast(kind).alias("candidate_id"), F.lit(what).alias("what"), position.cast("long").alias("position"), F.lit(None).cast("string").alias("class"))
    known = results.where(F.col("stage").isin(*names))
    inputs = row(candidates, F.lit(names[0]), "input", F.col("position")).unionByName(row(known.withColumn("stage", follows).where("stage is not null"), F.col("stage"), "input", F.col("position")))
    noted = gaps.select("stage", F.col("subject_id").cast(kind).alias("candidate_id"), F.lit("gap").alias("what"), F.lit(None).cast("long").alias("position"), F.when(F.col("stage").isin(*CLASSED), F.coalesce("failure_class", F.lit(""))).otherwise("").alias("class"))
    rows = inputs.unionByName(row(known, F.col("stage"), "result", F.col("position"))).unionByName(noted.where(F.col("stage").isin(*names)))
    count = lambda what: F.count_if(F.col("what") == what).alias(what)
    place = lambda what: F.min(F.when(F.col("what") == what, F.col("position"))).alias(f"{what}_at")
    met = rows.groupBy("stage", "candidate_id").agg(count("input"), count("result"), count("gap"), F.count_distinct("class").alias("classes"), place("input"), place("result"))
    both = met.where("input > 0 and result > 0 and gap = 0")
    ranked = running(running(both, ["stage"], ["input_at", "candidate_id"], name="input_rank"), ["stage"], ["result_at", "candidate_id"], name="result_rank")
    moved = ranked.where("input_rank <> result_rank").select("stage", "candidate_id", F.lit("OUT_OF_ORDER").alias("fault"))
    listed = {
        "REPEATED_RESULT": "result > 1", "REPEATED_GAP": "gap > classes", "NO_RESULT": "input > 0 and result = 0 and gap = 0", "RESULT_DESPITE_GAP": "result > 0 and gap > 0 and input > 0",
        "NO_INPUT": "result > 0 and input = 0", "UNKNOWN_SUBJECT": "gap > 0 and input = 0",
    }
    # a stage that the run never came to owes nothing
    reached = met.groupBy("stage").agg(F.sum("result").alias("results"), F.sum("gap").alias("noted"))
    open_ = met.join(F.broadcast(reached), "stage")  # a row for each stage of the chain
    found = F.filter(F.array(*[F.when(F.expr(x) & ((F.col("results") + F.col("noted") > 0) if n == "NO_RESULT" else F.lit(True)), F.lit(n)) for n, x in listed.items()]), lambda x: x.isNotNull())
    faults = open_.select("stage", "candidate_id", F.explode(found).alias("fault")).unionByName(moved)
    odd = results.select("stage", "candidate_id").unionByName(gaps.select("stage", F.col("subject_id").alias("candidate_id"))).where(~F.coalesce(F.col("stage").isin(*names), F.lit(False)))
    faults = faults.unionByName(odd.select("stage", "candidate_id", F.lit("UNKNOWN_STAGE").alias("fault")))
    nobody = F.lit(None).cast(kind).alias("candidate_id")
    owed = reached.withColumn("earlier", F.element_at(F.create_map(*[F.lit(x) for n, (e, _) in before.items() for x in (n, e)]), F.col("stage")))
    silent = owed.join(reached.where("results + noted > 0").select(F.col("stage").alias("earlier")), "earlier", "left_anti").where("results > 0 and earlier is not null")
    faults = faults.unionByName(silent.select("stage", nobody, F.lit("NO_PREDECESSOR").alias("fault")))
    twice = candidates.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    faults = faults.unionByName(twice.select(F.lit("candidates").alias("stage"), "candidate_id", F.lit("REPEATED_CANDIDATE").alias("fault")))
    if blocked:
        faults = faults.unionByName(reached.where("results > 0").select("stage", nobody, F.lit("BLOCKED").alias("fault")))
    return faults
