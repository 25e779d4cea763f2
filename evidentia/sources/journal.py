"""A journal of recorded answers: content-addressed, only ever added to, checked when read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running
from .tables import written

#: What becomes of a request: answered from the journal, to be made, over the budget of its kind, or its record was changed.
REPLAYED, LIVE, OVER_BUDGET, TAMPERED = "REPLAYED", "LIVE", "OVER_BUDGET", "TAMPERED"


def request_key(kind: Column, request: Column) -> Column:
    """The address of a request: a digest of its kind and content, with the length of the kind before them."""
    kind, request = (F.coalesce(c.cast("string"), F.lit("")) for c in (kind, request))
    return F.sha2(F.concat(F.length(kind).cast("string"), F.lit(":"), kind, request).cast("binary"), 256)


def records(calls: DataFrame) -> DataFrame:
    """Journal rows (key, response, digest) of calls (kind, request, response, definitive). Only definitive outcomes are
    recorded; equal requests keep the least response, so that a repeated write changes nothing."""
    kept = calls.where("definitive and response is not null").select(request_key(F.col("kind"), F.col("request")).alias("key"), F.col("response").cast("string").alias("response"))
    return kept.groupBy("key").agg(F.min("response").alias("response")).withColumn("digest", F.sha2(F.concat("key", "response").cast("binary"), 256))


def append(folder: str, calls: DataFrame) -> None:
    """Adds the records of calls that the journal in folder doesn't hold yet. Spark commits them whole or not at all."""
    found = records(calls)
    try:
        held = found.sparkSession.read.parquet(folder).select("key")
    except Exception as e:  # the first run of a journal
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = found.select("key").limit(0)
    fresh, _ = written(found.join(held, "key", "left_anti"))
    fresh.write.mode("append").parquet(folder)


def replay(requests: DataFrame, journal: DataFrame, budgets: dict[str, int], order: str) -> DataFrame:
    """requests with response and source: what a run that starts from this journal does with each.

    requests: kind, request and a column of order (total); journal: key, response, digest. A record whose digest
    doesn't belong to its key and response was changed and answers nothing (TAMPERED). Requests without a
    record are charged to the budget of their kind in order: those within it are LIVE, the rest OVER_BUDGET;
    a kind without a budget has none. Equal requests are answered alike and charged one by one.
    """
    sound = F.sha2(F.concat("key", "response").cast("binary"), 256) == F.col("digest")
    known = journal.select("key", F.col("response"), F.coalesce(sound, F.lit(False)).alias("sound"))
    known = known.groupBy("key").agg(F.min("response").alias("response"), F.bool_and("sound").alias("sound"), F.count_distinct("response").alias("n"))
    rows = requests.withColumn("key", request_key(F.col("kind"), F.col("request"))).join(known, "key", "left")
    rows = rows.withColumn("missing", F.col("n").isNull().cast("int"))
    rows = running(rows, ["kind"], [order], F.col("missing"), "charged")
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("kind")), F.lit(0)) if budgets else F.lit(0)
    sound = F.col("sound") & (F.col("n") == 1)
    source = F.when(F.col("n").isNotNull(), F.when(sound, REPLAYED).otherwise(TAMPERED)).when(F.col("charged") < limit, LIVE).otherwise(OVER_BUDGET)
    return rows.select(*requests.columns, F.when(sound, F.col("response")).alias("response"), source.alias("source"))
