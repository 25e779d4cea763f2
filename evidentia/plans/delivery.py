"""Queries over the delivery ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..sources.tables import table
from ..streaming import deliveries, ledger, weekly
from ._register import duck, given, query


def _transitions(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    state = F.when(F.col("event_type").isin("click", "view"), "ATTEMPTED").when(F.col("event_type") == "purchase", "SENT").when(F.col("event_type") == "signup", "NOT_SENT").otherwise("RELEASED")
    return e.select(F.col("user_id").cast("string").alias("recipient_key"), F.col("event_id").alias("seq"), state.alias("new_state"), (F.col("event_id") % 2).cast("string").alias("claim_id"))


@query("""
WITH RECURSIVE t AS (SELECT user_id::VARCHAR AS recipient_key, CASE WHEN event_type IN ('click', 'view') THEN 'ATTEMPTED' WHEN event_type = 'purchase' THEN 'SENT' WHEN event_type = 'signup' THEN 'NOT_SENT' ELSE 'RELEASED' END AS new_state,
    (event_id % 2)::VARCHAR AS claim, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
s AS (SELECT DISTINCT recipient_key, 0::BIGINT AS n, NULL::VARCHAR AS state, NULL::VARCHAR AS claim_id, 0::BIGINT AS legal, 0::BIGINT AS refused FROM t
  UNION ALL
  SELECT recipient_key, n, CASE WHEN good THEN new_state ELSE state END, CASE WHEN good THEN claim ELSE claim_id END, legal + good::BIGINT, refused + (NOT good)::BIGINT
  FROM (SELECT s.recipient_key, t.n, t.new_state, t.claim, s.state, s.claim_id, s.legal, s.refused,
    CASE WHEN t.new_state = 'ATTEMPTED' THEN s.state IS NULL OR s.state IN ('NOT_SENT', 'RELEASED') ELSE coalesce(s.state = 'ATTEMPTED' AND s.claim_id = t.claim, false) END AS good
    FROM s JOIN t ON s.recipient_key = t.recipient_key AND t.n = s.n + 1))
SELECT recipient_key, state, claim_id, legal, refused FROM s QUALIFY row_number() OVER (PARTITION BY recipient_key ORDER BY n DESC) = 1""")
def ledger_fold(spark, d):
    """Users as recipients, their events as transitions, claims by the parity of the event."""
    return ledger.fold(_transitions(spark, d))


_AGED = """
WITH RECURSIVE t AS (SELECT user_id::VARCHAR AS recipient_key, CASE WHEN event_type IN ('click', 'view') THEN 'ATTEMPTED' WHEN event_type = 'purchase' THEN 'SENT' ELSE 'NOT_SENT' END AS new_state,
    (event_id % 2)::VARCHAR AS claim, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT DISTINCT recipient_key, 0::BIGINT AS n, NULL::VARCHAR AS state, NULL::VARCHAR AS claim_id, NULL::TIMESTAMP AS since, 0::BIGINT AS legal, 0::BIGINT AS refused FROM t
  UNION ALL
  SELECT recipient_key, n, CASE WHEN good THEN new_state ELSE aged END, CASE WHEN good THEN claim ELSE claim_id END, CASE WHEN good AND new_state = 'ATTEMPTED' THEN ts ELSE since END, legal + good::BIGINT, refused + (NOT good)::BIGINT
  FROM (SELECT *, CASE WHEN new_state = 'ATTEMPTED' THEN aged IS NULL OR aged IN ('NOT_SENT', 'RELEASED') ELSE coalesce(aged = 'ATTEMPTED' AND claim_id = claim, false) END AS good
    FROM (SELECT s.recipient_key, t.n, t.new_state, t.claim, t.ts, s.claim_id, s.since, s.legal, s.refused, CASE WHEN s.state = 'ATTEMPTED' AND t.ts - s.since >= INTERVAL 24 HOURS THEN 'RELEASED' ELSE s.state END AS aged
      FROM s JOIN t ON s.recipient_key = t.recipient_key AND t.n = s.n + 1)))
SELECT recipient_key, CASE WHEN state = 'ATTEMPTED' AND (SELECT max(ts) FROM t) - since >= INTERVAL 24 HOURS THEN 'RELEASED' ELSE state END AS state, claim_id, legal, refused
FROM s QUALIFY row_number() OVER (PARTITION BY recipient_key ORDER BY n DESC) = 1"""


def _timed(events: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type").isin("click", "view"), "ATTEMPTED").when(F.col("event_type") == "purchase", "SENT").otherwise("NOT_SENT")
    rows = events.where("event_type <> 'error'")
    return rows.select(F.col("user_id").cast("string").alias("recipient_key"), F.col("event_id").alias("seq"), state.alias("new_state"), (F.col("event_id") % 2).cast("string").alias("claim_id"), F.col("ts").cast("timestamp").alias("ts"))


@query(_AGED)
def ledger_fold_with_release(spark, d):
    """The fold with claims that are released after a day."""
    rows = _timed(table(spark, d, "events"))
    return ledger.fold(rows, at="ts", until=rows.agg(F.max("ts")).scalar())


@query(_AGED)
def ledger_stream(spark, d):
    """The same as a stream with a state for each recipient and a timer for each open claim."""
    return deliveries.run_stream(spark, _timed(weekly.event_stream(spark, f"{d}/events.parquet")))


@query("""
WITH r AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM events),
s AS (SELECT *, count(*) FILTER (pause IS NULL OR pause > INTERVAL 30 MINUTES) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return weekly.sessions(table(spark, d, "events"), "user_id").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("""
WITH r AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pause FROM events),
s AS (SELECT *, count(*) FILTER (pause IS NULL OR pause > INTERVAL 30 MINUTES) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM r)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def closed_sessions(spark, d):
    """Sessions as a stream in append mode: those that the watermark, an hour behind the last event, has closed."""
    found = weekly.appended(spark, weekly.sessions(weekly.event_stream(spark, f"{d}/events.parquet"), "user_id"))
    return found.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("""
WITH w AS (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM events)
SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_counts(spark, d):
    found = weekly.sliding(table(spark, d, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_OUTCOMES = "SELECT user_id, user_id % 50 AS delivery, CASE WHEN max(event_id) % 5 < 2 THEN 'SENT' WHEN max(event_id) % 5 < 4 OR user_id % 50 < 25 THEN 'ALREADY_SENT' ELSE 'REJECTED' END AS outcome FROM {events} GROUP BY user_id"


@query(f"""
WITH o AS ({duck(_OUTCOMES)})
SELECT delivery, count(*) AS recipients, count(*) FILTER (outcome = 'SENT') AS sent, count(*) FILTER (outcome = 'ALREADY_SENT') AS already_sent,
  CASE WHEN count(*) FILTER (outcome IN ('SENT', 'ALREADY_SENT')) < count(*) THEN 'FAILED' WHEN count(*) FILTER (outcome = 'SENT') > 0 THEN 'SENT' ELSE 'DUPLICATE' END AS status FROM o GROUP BY 1""")
def delivery_roll_up(spark, d):
    return ledger.roll_up(given(spark, d, _OUTCOMES), "delivery")


_LEDGER = """SELECT CAST(c_custkey AS STRING) AS recipient_key, c_nationkey AS period, CASE c_custkey % 4 WHEN 0 THEN 'SENT' WHEN 1 THEN 'NOT_SENT' ELSE 'ATTEMPTED' END AS state, CAST(c_custkey % 3 AS STRING) AS claim_id,
  CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-02 12:00:00' ELSE TIMESTAMP '2024-01-01 06:30:00' END AS claimed_at FROM {customer}"""
_TOLD = "SELECT CAST(c_custkey AS STRING) AS recipient_key, CAST(c_custkey % 2 AS STRING) AS claim_id, CASE c_custkey % 5 WHEN 0 THEN 'NOT_SENT' WHEN 1 THEN 'LOST' ELSE 'SENT' END AS new_state FROM {customer} WHERE c_custkey % 7 < 5"


@query(f"""
WITH l AS ({duck(_LEDGER)}), t AS ({duck(_TOLD)}), j AS (SELECT l.*, t.new_state, coalesce(l.state = 'ATTEMPTED' AND l.claim_id = t.claim_id AND t.new_state IN ('SENT', 'NOT_SENT', 'RELEASED'), false) AS written FROM l LEFT JOIN t USING (recipient_key))
SELECT recipient_key, CASE WHEN written THEN new_state ELSE state END AS state, claim_id, written FROM j""")
def recorded_outcomes(spark, d):
    return ledger.record(given(spark, d, _LEDGER), given(spark, d, _TOLD))


@query(f"""
WITH l AS ({duck(_LEDGER)}), y AS (SELECT period, bool_or(state = 'ATTEMPTED' AND date_diff('second', claimed_at, TIMESTAMP '2024-01-03 00:00:00') < 24 * 3600) AS young FROM l GROUP BY 1)
SELECT period, recipient_key, CASE WHEN state = 'ATTEMPTED' AND NOT young THEN 'RELEASED' ELSE state END AS state, state = 'ATTEMPTED' AND NOT young AS released FROM l JOIN y USING (period)""")
def released_claims(spark, d):
    return ledger.release(given(spark, d, _LEDGER), "period", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")).select("period", "recipient_key", "state", "released")


@query(f"""
WITH l AS ({duck(_LEDGER)}), o AS (SELECT s_suppkey::VARCHAR AS recipient_key, 'SEEN_' || s_nationkey AS observation FROM supplier),
j AS (SELECT coalesce(a.recipient_key, o.recipient_key) AS recipient_key, coalesce(observation, (date_diff('second', claimed_at, TIMESTAMP '2024-01-03 00:00:00') // 3600) || 'h', 'UNKNOWN') AS told
  FROM (SELECT * FROM l WHERE state = 'ATTEMPTED') a FULL JOIN o USING (recipient_key))
SELECT recipient_key, recipient_key || ' ' || told AS line FROM j""")
def claim_lines(spark, d):
    seen = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("recipient_key"), F.concat(F.lit("SEEN_"), "s_nationkey").alias("observation"))
    return ledger.claim_lines(given(spark, d, _LEDGER), seen, F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))


@query("""
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events""")
def numbered_log(spark, d):
    return ledger.numbered_log(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query(f"""
WITH l AS ({duck(_LEDGER)}) SELECT recipient_key, state, claim_id, true AS valid FROM l UNION ALL SELECT 'x', NULL, NULL, false UNION ALL SELECT 'y', 'SENT', '1', false""")
def ledger_entries(spark, d):
    """The ledger written as JSON and read again, with an entry that lacks fields and one that has another."""
    odd = spark.createDataFrame([('{"recipient_key":"x"}',), ('{"claim_id":"1","recipient_key":"y","state":"SENT","more":1}',)], "entry string")
    return ledger.parsed(ledger.serialised(given(spark, d, _LEDGER)).unionByName(odd))


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_type IN ('click', 'view') AS again FROM events)
SELECT user_id, event_id, attempt FROM (SELECT *, coalesce(bool_or(NOT again) OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stopped FROM r) WHERE attempt <= 2 AND NOT stopped""")
def bounded_retry(spark, d):
    return ledger.attempts_within(table(spark, d, "events"), "user_id", "event_id", F.col("event_type").isin("click", "view")).select("user_id", "event_id", "attempt")


@query("""
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY event_id) AS used FROM events QUALIFY used <= 12""")
def budget_limit(spark, d):
    """Calls of each kind and day up to a limit."""
    rows = table(spark, d, "events").withColumn("kind", F.concat_ws(":", "event_type", F.col("ts").cast("date")))
    return ledger.within_limit(rows, "kind", "event_id", 12).select("event_type", "event_id", "used")


@query("""
SELECT c_custkey, 'a' || c_custkey || '@x.org;b@y.net' AS addresses FROM customer""")
def recipient_lists(spark, d):
    listed = F.concat(F.lit("A"), "c_custkey", F.lit("@X.org, b@y.net;nobody, b@Y.NET;\na@b"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(ledger.recipients(listed), ";").alias("addresses"))


@query()
def recipient_keys(spark, d):
    """Keyed hashes of recipients; the SQL engine has no HMAC, so the tests hold them against Python's."""
    return table(spark, d, "customer").select("c_custkey", ledger.recipient_key(F.col("c_name"), b"fixture").alias("recipient_key"))


@query("""
SELECT event_id, (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts)) // 3600000000 AS age_hours, epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(ts) >= 86400000000 AS releasable FROM events""")
def claim_ages(spark, d):
    age = dates.hours_since(F.col("ts").cast("timestamp_ntz"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", age.alias("age_hours"), (age >= ledger.RELEASE_HOURS).alias("releasable"))
