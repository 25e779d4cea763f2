"""The queries of the library, by name, each with its SQL where SQL can express it.

Tables stand in for evidence tables as the survey lays out: orders are dated candidates, customers their
events, nations and regions their places, events a request log, documents and pages their sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, ids, text, urls
from ..operators import aggregates as agg
from ..operators import constraints, dedup, entities, lookup, proposals, temporal
from ..sources import html
from ..sources.tables import dealt, table
from ..streaming import weekly
from . import delivery, details, discovery, identity, prose, report, review, sources, trials  # noqa: F401
from ._register import ORACLES, QUERIES, duck, given, query  # noqa: F401

REPORT_START, REPORT_END = "1997-03-10", "1997-03-16"
ALLOWED_REGIONS = ("ASIA", "EUROPE", "AMERICA")
STATUS_KIND = {"F": "NOTICE_PUBLISHED", "O": "ORIGINAL_PUBLICATION", "P": "MODIFIED"}


def _day(c) -> F.Column:
    return c.cast("date")


# ---- identifiers and urls


@query("""
SELECT page_id, 'cand_' || sha256('{"url":"' || url || '"}') AS candidate_id FROM pages""")
def candidate_ids(spark, d):
    return table(spark, d, "pages").select("page_id", ids.content_id("cand_", url=F.col("url")).alias("candidate_id"))


@query("""
SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1))
  || coalesce(nullif(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') || regexp_extract(url, '(\\?[^#]*)', 1) AS identity_url FROM pages""")
def url_identity_form(spark, d):
    return table(spark, d, "pages").select("page_id", urls.identity_form(F.col("url")).alias("identity_url"))


_TRACKED = """SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN page_id % 4 = 0 THEN '' WHEN url LIKE '%?%' THEN '&' ELSE '?' END
  || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'utm%5Fsource=x&b=1' WHEN 2 THEN 'c=2&&FB%63lid=3&d' ELSE 'gclid&e%zz=4' END || CASE WHEN page_id % 5 = 0 THEN '#top' ELSE '' END AS url FROM {pages}"""


@query(f"""
WITH u AS ({duck(_TRACKED)}), parts AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '\\?([^#]*)', 1) AS q, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS place FROM u),
kept AS (SELECT page_id, base, place, array_to_string(list_filter(string_split(q, '&'), lambda p: NOT regexp_matches(url_decode(replace(split_part(p, '=', 1), '+', ' ')), '(?i)^(utm_.*|fbclid|gclid)$')), '&') AS q FROM parts)
SELECT page_id, CASE WHEN place <> '' AND regexp_matches(base, '(?i)^https?://') THEN base || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE '' END AS clean_url FROM kept""")
def url_strip_tracking(spark, d):
    """Urls of pages with tracking parameters, some of which have encoded names."""
    return given(spark, d, _TRACKED).select("page_id", urls.strip_tracking(F.col("url")).alias("clean_url"))


@query("""
SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host,
  lower(split_part(url, '://', 1)) || '|' || regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') || '||'
  || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END
  || '|' || regexp_extract(url, '\\?([^#]*)', 1) AS resource_key,
  regexp_matches(url, '^https?://[^/?#\\s]+') AND NOT regexp_matches(url, '\\s') AS exact_url FROM pages""")
def url_resource_key(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.resource_key(u).alias("resource_key"), urls.exact(u).alias("exact_url"))


@query("""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS publisher, count(*) AS pages, count(DISTINCT host) AS hosts,
  count(*) FILTER (host = regexp_extract(host, '([^.]+\\.[^.]+)$', 1) OR ends_with(host, '.' || regexp_extract(host, '([^.]+\\.[^.]+)$', 1))) AS same
FROM h GROUP BY 1""")
def same_publisher(spark, d):
    rows = table(spark, d, "pages").select(urls.host(F.col("url")).alias("host"))
    rows = rows.withColumn("publisher", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    return rows.groupBy("publisher").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"), F.count_if(urls.same_publisher(F.col("host"), F.col("publisher"))).alias("same"))


# ---- deduplication


@query("""
SELECT source, r.lang AS lang, r.n_chars AS n_chars, r.doc_id AS doc_id, occurrences, languages FROM (
  SELECT source, min({'lang': lang, 'n_chars': n_chars, 'doc_id': doc_id}) AS r, count(*) AS occurrences, count(DISTINCT lang) AS languages
  FROM documents GROUP BY source)""")
def candidate_representative(spark, d):
    return dedup.representatives(table(spark, d, "documents"), "source", ("lang", "n_chars", "doc_id"), languages=F.count_distinct("lang"))


@query("""
SELECT source, sha256(text) AS text_hash, count(*) AS copies, min(lang) <> max(lang) AS conflicting FROM documents GROUP BY 1, 2""")
def occurrence_dedup(spark, d):
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("text_hash"), "lang")
    return dedup.occurrences(docs, ("source", "text_hash"), F.col("lang"))


@query("""
SELECT sha256(text) AS source_key, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY text HAVING count(*) > 1""")
def exact_source_groups(spark, d):
    return dedup.exact_source_groups(table(spark, d, "documents"), F.sha2("text", 256), "doc_id")


@query("""
SELECT a.doc_id AS doc_id, a.doc_id <> b.keep AS duplicate FROM documents a JOIN (SELECT text, min(doc_id) AS keep FROM documents GROUP BY text) b ON a.text = b.text
""")
def exact_source_members(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    keep = docs.groupBy("key").agg(F.min("doc_id").alias("keep"))
    return docs.join(keep, "key").select("doc_id", (F.col("doc_id") != F.col("keep")).alias("duplicate"))


# ---- dates


@query("""
SELECT date_trunc('week', ts)::DATE AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def week_bucket(spark, d):
    return weekly.weekly(table(spark, d, "events"))


@query("""
SELECT date_trunc('week', ts)::DATE AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def week_bucket_stream(spark, d):
    return weekly.weekly_from_stream(spark, f"{d}/events.parquet")


@query("""
WITH e AS (SELECT event_id, (ts + INTERVAL 8 HOUR)::DATE AS day FROM events)
SELECT date_trunc('week', day)::DATE - 7 AS period_start, date_trunc('week', day)::DATE - 1 AS period_end, count(*) AS n FROM e GROUP BY ALL""")
def default_period(spark, d):
    rows = table(spark, d, "events").select(dates.previous_week(F.col("ts").cast("timestamp")).alias("p"))
    return rows.groupBy(F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT date_trunc('week', o_orderdate)::DATE AS ws FROM orders), w AS (SELECT ws, ws + 6 AS we, count(*) AS n FROM o GROUP BY ws)
SELECT ws AS week_start, CASE WHEN last_day(ws) <= we THEN date_trunc('month', ws)::DATE END AS month_start, n FROM w""")
def check_month_of_week(spark, d):
    rows = table(spark, d, "orders").select(dates.week_start(_day(F.col("o_orderdate"))).alias("week_start"))
    weeks = rows.groupBy("week_start").agg(F.count(F.lit(1)).alias("n"))
    return weeks.select("week_start", dates.month_of_week(F.col("week_start"), F.date_add("week_start", 6))["start"].alias("month_start"), "n")


@query(f"""
SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate::DATE BETWEEN DATE '{REPORT_START}' - 1 AND DATE '{REPORT_END}' + 1""")
def publication_window(spark, d):
    day = _day(F.col("o_orderdate"))
    return table(spark, d, "orders").where(dates.in_window(day, F.lit(REPORT_START).cast("date"), F.lit(REPORT_END).cast("date"))).select("o_orderkey")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value - 20 ELSE round(value * 40) END AS ms FROM events)
SELECT event_id, CASE WHEN ms < 0 OR ms <> floor(ms) THEN NULL WHEN ms < 10 THEN '0-9ms' WHEN ms < 50 THEN '10-49ms' WHEN ms < 100 THEN '50-99ms' WHEN ms < 250 THEN '100-249ms'
  WHEN ms < 500 THEN '250-499ms' WHEN ms < 1000 THEN '500-999ms' WHEN ms < 5000 THEN '1000-4999ms' WHEN ms < 10000 THEN '5000-9999ms' WHEN ms IS NOT NULL THEN '10000ms+' END AS bucket FROM e""")
def latency_buckets(spark, d):
    ms = F.when(F.col("event_id") % 3 == 0, F.col("value") - 20).otherwise(F.round(F.col("value") * 40))
    return table(spark, d, "events").select("event_id", dates.latency_bucket(ms).alias("bucket"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN h < 0 THEN NULL WHEN h <= 20 THEN h::VARCHAR ELSE '20+' END AS bucket
FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 4 - 5 AS h FROM lineitem)""")
def hop_buckets(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dates.hop_bucket(F.col("l_linenumber") * 4 - 5).alias("bucket"))


@query("""
WITH f AS (
  SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS raw, CASE o_orderstatus WHEN 'F' THEN 'NOTICE_PUBLISHED' WHEN 'O' THEN 'ORIGINAL_PUBLICATION' ELSE 'MODIFIED' END AS kind FROM orders
  UNION ALL SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%dT10:00:00Z'), CASE WHEN l_returnflag = 'R' THEN 'NOTICE_PUBLISHED' WHEN l_returnflag = 'A' THEN 'NOTICE_ISSUED' ELSE 'EVENT_DATE' END FROM lineitem),
c AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN 'notice' WHEN o_orderpriority LIKE '2%' THEN 'unknown' ELSE 'other' END AS st,
  date_trunc('month', o_orderdate)::DATE AS ps, last_day(o_orderdate) AS pe FROM orders),
r AS (SELECT c.*, f.raw[1:10]::DATE AS day, CASE
    WHEN st = 'notice' THEN list_position(['NOTICE_PUBLISHED', 'NOTICE_ISSUED', 'ORIGINAL_PUBLICATION'], kind)
    WHEN st = 'unknown' THEN list_position(['ORIGINAL_PUBLICATION', 'NOTICE_PUBLISHED', 'NOTICE_ISSUED'], kind)
    ELSE list_position(['ORIGINAL_PUBLICATION'], kind) END AS pr FROM c JOIN f USING (k)),
b AS (SELECT *, min(pr) OVER (PARTITION BY k) AS best FROM r),
g AS (SELECT k, any_value(ps) AS ps, any_value(pe) AS pe, count(pr) AS usable, count(DISTINCT day) FILTER (pr = best) AS days, min(day) FILTER (pr = best) AS day FROM b GROUP BY k),
x AS (SELECT *, CASE WHEN usable = 0 THEN 'DATE_PROVENANCE_INVALID' WHEN days > 1 THEN 'DATE_CONFLICT' WHEN day NOT BETWEEN ps AND pe THEN 'OUT_OF_RANGE' ELSE 'NONE' END AS diagnostic FROM g)
SELECT k AS candidate_id, diagnostic = 'NONE' AS date_valid, diagnostic, CASE WHEN usable > 0 AND days = 1 THEN day END AS controlling_date FROM x""")
def temporal_decision(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    kind = F.lit("MODIFIED")
    for status, name in STATUS_KIND.items():
        kind = F.when(F.col("o_orderstatus") == status, name).otherwise(kind)
    facts = orders.select(F.col("o_orderkey").alias("candidate_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("raw"), kind.alias("kind"))
    shipped = F.when(F.col("l_returnflag") == "R", "NOTICE_PUBLISHED").when(F.col("l_returnflag") == "A", "NOTICE_ISSUED").otherwise("EVENT_DATE")
    facts = facts.unionByName(items.select(F.col("l_orderkey").alias("candidate_id"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T10:00:00Z")).alias("raw"), shipped.alias("kind")))
    priority, day = F.substring("o_orderpriority", 1, 1), _day(F.col("o_orderdate"))
    candidates = orders.select(
        F.col("o_orderkey").alias("candidate_id"), F.when(priority == "1", "notice").when(priority == "2", "unknown").otherwise("other").alias("source_type"),
        F.trunc(day, "MM").alias("period_start"), F.last_day(day).alias("period_end"), F.lit(None).cast("string").alias("discovered"),
    )
    return temporal.decide(candidates, facts)


# ---- order, members and sections


def _members(spark, d) -> DataFrame:
    """Orders as members of customer-week events, with their place."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    day = _day(F.col("o_orderdate"))
    rows = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", day.alias("day"), dates.week_start(day).alias("week"))
    rows = rows.withColumn("event_key", F.concat_ws(":", "o_custkey", "week"))
    return rows.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


_MEMBERS = """
m AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate::DATE AS day, date_trunc('week', o_orderdate)::DATE AS week,
  o_custkey || ':' || date_trunc('week', o_orderdate)::DATE AS event_key, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""
WITH {_MEMBERS}, g AS (SELECT event_key, min({{'o_orderpriority': o_orderpriority, 'o_orderkey': o_orderkey}}) AS r, count(*) AS members, max(day) AS day, any_value(c_nationkey) AS nk FROM m GROUP BY event_key)
SELECT event_key, r.o_orderkey AS representative, r.o_orderpriority AS category, members, day, r_name AS region FROM g JOIN nation ON nk = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def event_report(spark, d):
    """The flagship: each customer's orders of a week are one event with a representative, a date and a region."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    found = dedup.representatives(_members(spark, d), "event_key", ("o_orderpriority", "o_orderkey"), day=F.max("day"), c_nationkey=F.any_value("c_nationkey"))
    return found.join(places, "c_nationkey").select("event_key", F.col("o_orderkey").alias("representative"), F.col("o_orderpriority").alias("category"), F.col("occurrences").alias("members"), "day", "region")


def _ordered_events(spark, d) -> DataFrame:
    """Events of all weeks with their position in the report of their week."""
    events = _members(spark, d).groupBy("week", "event_key").agg(F.max("day").alias("day"))
    return events.withColumn("position", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("day"), "event_key")))


def _sectioned_events(spark, d) -> DataFrame:
    """Events of all weeks with their position in their section of the report of their week."""
    events = _members(spark, d).groupBy("week", "event_key").agg(F.max("day").alias("day"), F.min("o_orderpriority").alias("section"))
    rank = agg.ordinal(F.col("section"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    return events.select("week", "event_key", "section", rank.alias("section_order"), F.row_number().over(Window.partitionBy("week", "section").orderBy(F.desc("day"), "event_key")).alias("position"), "day")


@query(f"""
WITH {_MEMBERS}, g AS (SELECT event_key, max(day) AS day FROM m WHERE week = DATE '{REPORT_START}' GROUP BY event_key)
SELECT event_key, day, row_number() OVER (ORDER BY day DESC, event_key) AS position FROM g""")
def event_order(spark, d):
    """The report of one week; event_order_all_weeks has every week."""
    return _ordered_events(spark, d).where(F.col("week") == F.lit(REPORT_START).cast("date")).select("event_key", "day", "position")


@query(f"""
WITH {_MEMBERS}, g AS (SELECT week, event_key, max(day) AS day FROM m GROUP BY ALL)
SELECT week, event_key, day, row_number() OVER (PARTITION BY week ORDER BY day DESC, event_key) AS position FROM g""")
def event_order_all_weeks(spark, d):
    return _ordered_events(spark, d).select("week", "event_key", "day", "position")


@query(f"""
WITH {_MEMBERS}, g AS (SELECT event_key, max(day) AS day, min(o_orderpriority) AS section FROM m WHERE week = DATE '{REPORT_START}' GROUP BY event_key)
SELECT event_key, section, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], section) - 1 AS section_order,
  row_number() OVER (PARTITION BY section ORDER BY day DESC, event_key) AS position FROM g""")
def sectioned_report_order(spark, d):
    """The report of one week; sectioned_report_order_all_weeks has every week."""
    return _sectioned_events(spark, d).where(F.col("week") == F.lit(REPORT_START).cast("date")).select("event_key", "section", "section_order", "position")


@query(f"""
WITH {_MEMBERS}, g AS (SELECT week, event_key, max(day) AS day, min(o_orderpriority) AS section FROM m GROUP BY ALL)
SELECT week, event_key, section, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], section) - 1 AS section_order,
  row_number() OVER (PARTITION BY week, section ORDER BY day DESC, event_key) AS position FROM g""")
def sectioned_report_order_all_weeks(spark, d):
    return _sectioned_events(spark, d).select("week", "event_key", "section", "section_order", "position")


@query(f"""
WITH {_MEMBERS} SELECT event_key, o_orderkey FROM m QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY o_orderstatus <> 'F', o_totalprice DESC, o_orderkey) = 1""")
def canonical_member(spark, d):
    return temporal.canonical_member(_members(spark, d), "event_key", F.col("o_orderstatus") != "F", F.desc("o_totalprice"), F.col("o_orderkey")).select("event_key", "o_orderkey")


@query(f"""
WITH {_MEMBERS}, s AS (SELECT event_key, o_orderpriority AS value, o_orderkey AS member FROM m)
SELECT event_key, count(DISTINCT value) AS versions, string_agg(member || '=' || value, ';' ORDER BY member, value) AS stated FROM s GROUP BY event_key HAVING count(DISTINCT value) > 1""")
def unresolved_claims(spark, d):
    claims = _members(spark, d).select("event_key", F.lit("priority").alias("claim"), F.col("o_orderpriority").alias("value"), "o_orderkey")
    found = agg.unresolved_claims(claims, "event_key", "claim", "value", "o_orderkey")
    return found.select("event_key", "versions", F.array_join(F.transform("stated", lambda s: F.concat(s["o_orderkey"], F.lit("="), s["value"])), ";").alias("stated"))


# ---- audit


def _audit(spark, d) -> DataFrame:
    """One row per candidate with the first stage that ended it."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    end = F.coalesce(
        F.when(F.col("o_orderstatus") == "P", F.struct(F.lit("EVIDENCE").alias("stage"), F.lit("CONTENT_UNAVAILABLE").alias("reason"))),
        F.when(F.col("c_acctbal") < 0, F.struct(F.lit("SCOPE").alias("stage"), F.lit("SCOPE_NOT_ESTABLISHED").alias("reason"))),
        F.when(F.year("o_orderdate") < 1995, F.struct(F.lit("TEMPORAL").alias("stage"), F.lit("OUT_OF_RANGE").alias("reason"))),
        F.when(~F.col("r_name").isin(*ALLOWED_REGIONS), F.struct(F.lit("METADATA").alias("stage"), F.lit("REGION_NOT_DESIGNATED").alias("reason"))),
        F.struct(F.lit("FINAL_REPORT").alias("stage"), F.lit("INCLUDED").alias("reason")),
    )
    return rows.select("o_orderkey", end.alias("end")).select("o_orderkey", "end.stage", "end.reason")


_AUDIT = f"""
a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ['EVIDENCE', 'CONTENT_UNAVAILABLE'] WHEN c_acctbal < 0 THEN ['SCOPE', 'SCOPE_NOT_ESTABLISHED']
  WHEN year(o_orderdate) < 1995 THEN ['TEMPORAL', 'OUT_OF_RANGE'] WHEN r_name NOT IN {ALLOWED_REGIONS} THEN ['METADATA', 'REGION_NOT_DESIGNATED'] ELSE ['FINAL_REPORT', 'INCLUDED'] END AS e
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


@query(f"WITH {_AUDIT} SELECT o_orderkey, e[1] AS stage, e[2] AS reason FROM a")
def terminal_stage(spark, d):
    return _audit(spark, d)


@query(f"WITH {_AUDIT} SELECT e[1] AS stage, e[2] AS reason, list_position(['EVIDENCE', 'SCOPE', 'TEMPORAL', 'METADATA', 'FINAL_REPORT'], e[1]) - 1 AS stage_order, count(*) AS n FROM a GROUP BY ALL")
def terminal_distribution(spark, d):
    counts = _audit(spark, d).groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("stage_order", agg.ordinal(F.col("stage"), ("EVIDENCE", "SCOPE", "TEMPORAL", "METADATA", "FINAL_REPORT")))


@query(f"""WITH {_AUDIT} SELECT count(*) AS candidates, count(*) FILTER (e[1] = 'FINAL_REPORT') AS included, count(*) FILTER (e[2] = 'OUT_OF_RANGE') AS out_of_range,
  count(*) FILTER (e[2] = 'SCOPE_NOT_ESTABLISHED') AS out_of_scope, count(*) FILTER (e[2] = 'REGION_NOT_DESIGNATED') AS other_region FROM a""")
def disclosure_counts(spark, d):
    reason = F.col("reason")
    return _audit(spark, d).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("stage") == "FINAL_REPORT").alias("included"), F.count_if(reason == "OUT_OF_RANGE").alias("out_of_range"),
        F.count_if(reason == "SCOPE_NOT_ESTABLISHED").alias("out_of_scope"), F.count_if(reason == "REGION_NOT_DESIGNATED").alias("other_region"),
    )


@query("""
SELECT 0 AS position, 'customers' AS stage, count(*) AS n FROM customer UNION ALL SELECT 1, 'orders', count(*) FROM orders
UNION ALL SELECT 2, 'dated', count(*) FROM orders WHERE o_orderdate IS NOT NULL UNION ALL SELECT 3, 'final', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def stage_counts(spark, d):
    orders = table(spark, d, "orders")
    return agg.stage_counts(customers=table(spark, d, "customer"), orders=orders, dated=orders.where("o_orderdate is not null"), final=orders.where("o_orderstatus = 'F'"))


# ---- distributions


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, user_id LIMIT 5")
def reason_top_k(spark, d):
    return agg.top(agg.distribution(table(spark, d, "events"), F.col("user_id"), "user_id"), "user_id", 5)


@query("""
WITH s AS (SELECT user_id, count(*) AS n, min(event_id) AS first FROM events WHERE user_id IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first, user_id) AS k FROM s)
SELECT CASE WHEN k <= 31 THEN user_id::VARCHAR ELSE 'OTHER' END AS user_id, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def first_seen_cap(spark, d):
    return agg.capped_by_first_seen(table(spark, d, "events"), "user_id", "event_id", 31)


@query("""
SELECT 'event_type' AS dimension, event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'user_band', (user_id // 100)::VARCHAR, count(*) FROM events WHERE user_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'hour', hour(ts)::VARCHAR, count(*) FROM events GROUP BY ALL""")
def parallel_distributions(spark, d):
    return agg.distributions(table(spark, d, "events"), event_type=F.col("event_type"), user_band=F.floor(F.col("user_id") / 100), hour=F.hour("ts"))


@query("""
SELECT concat_ws(';', o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'large' END, o_orderpriority) AS signature, count(*) AS n FROM orders GROUP BY 1""")
def composite_signatures(spark, d):
    return agg.signatures(table(spark, d, "orders"), F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 200000, "large"), F.col("o_orderpriority"))


@query("""
SELECT event_type, hour(ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users, grouping_id(event_type, hour(ts)) AS g FROM events GROUP BY GROUPING SETS ((event_type), (hour(ts)), (event_type, hour(ts)))
""".replace(", grouping_id(event_type, hour(ts)) AS g", ", CASE grouping_id(event_type, hour(ts)) WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS grouping_set"))
def grouping_sets_roll_up(spark, d):
    rows = table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return agg.roll_up(rows, (("event_type",), ("hour",), ("event_type", "hour")), n=F.count(F.lit(1)), users=F.count_distinct("user_id"))


@query("""
SELECT user_id, event_type, count(DISTINCT ts::DATE) AS procedures FROM events GROUP BY 1, 2 HAVING count(DISTINCT ts::DATE) >= 2""")
def agreement_vote(spark, d):
    votes = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("procedure"))
    return agg.agreed(votes, ("user_id", "event_type"), "procedure")


# ---- regions


@query("""
WITH m AS (SELECT l_orderkey, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT l_orderkey AS event_id, count(DISTINCT r_name) AS k, min(r_name) AS region FROM m JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT event_id, CASE WHEN k = 1 THEN region END AS region, CASE WHEN k = 1 THEN 'NONE' ELSE 'CONFLICT' END AS diagnostic FROM g""")
def region_agreement(spark, d):
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_suppkey").join(places.select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("region")), "l_suppkey")
    return agg.one_or_conflict(rows, "event_id", "region")


@query(f"""
WITH m AS (SELECT DISTINCT l_orderkey, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT l_orderkey AS event_id, count(*) AS k, min(r_name) AS region FROM m GROUP BY 1)
SELECT event_id, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL WHEN k > 1 THEN 'REGION_CONFLICT' WHEN region NOT IN {ALLOWED_REGIONS} THEN 'REGION_NOT_DESIGNATED' END AS excluded
FROM g JOIN orders ON o_orderkey = event_id""")
def region_eligibility(spark, d):
    found = region_agreement(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderpriority"), "event_id")
    reason = proposals.eligible(F.col("region"), F.col("region").isin(*ALLOWED_REGIONS), F.col("diagnostic") == "CONFLICT", F.col("o_orderpriority") == "1-URGENT")
    return found.select("event_id", reason.alias("excluded"))


@query("""
WITH named AS (SELECT doc_id, item_id FROM documents, (SELECT item_id, text AS name FROM benchmark) b WHERE contains(text, name))
SELECT doc_id, count(DISTINCT item_id) AS names, min(item_id) AS first_name FROM named GROUP BY doc_id""")
def contained_names(spark, d):
    """Documents and the benchmark passages in them."""
    names = table(spark, d, "benchmark").select("item_id", F.col("text").alias("name"))
    found = lookup.contained(table(spark, d, "documents"), "doc_id", "text", names, "item_id", "name")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("names"), F.min("item_id").alias("first_name"))


# ---- joins and sets


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def left_semi_written(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def left_anti_excluded(spark, d):
    out = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(out, "c_custkey", "left_anti").select("c_custkey")


@query("""
SELECT doc_id, 1 AS in_whole, (SELECT count(*) FROM labels l WHERE l.doc_id = documents.doc_id) AS in_parts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def exact_partition(spark, d):
    labels = table(spark, d, "labels")
    return constraints.exact_partition(table(spark, d, "documents"), "doc_id", good=labels.where("quality = 1"), bad=labels.where("quality <> 1"))


@query("""
WITH l AS (SELECT lang, n_chars FROM documents WHERE source < 'src2'), r AS (SELECT lang, n_chars FROM documents WHERE source >= 'src1')
SELECT lang, n_chars, 'left' AS side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) UNION ALL SELECT lang, n_chars, 'right' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def set_symmetric_difference(spark, d):
    docs = table(spark, d, "documents")
    return constraints.symmetric_difference(docs.where("source < 'src2'").select("lang", "n_chars"), docs.where("source >= 'src1'").select("lang", "n_chars"))


@query("""
WITH x AS (SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1), y AS (SELECT lang, source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)
SELECT lang, source FROM x INTERSECT SELECT lang, source FROM y""")
def set_intersection(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.where("quality = 1").select("lang", "source").intersect(rows.where("quality = 0").select("lang", "source"))


@query("""
WITH g AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))::BIGINT AS same_label,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM documents GROUP BY text))::BIGINT AS merged, (SELECT sum(n * (n - 1) // 2) FROM g)::BIGINT AS both""")
def label_pair_scoring(spark, d):
    return agg.pair_scores(table(spark, d, "documents").select(F.sha2("text", 256).alias("grp"), "lang"), "grp", "lang")


@query("""
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents""")
def round_robin_sample(spark, d):
    return agg.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""
SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER w AS running, row_number() OVER w AS place FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
WHERE place = 1 OR (place <= 4 AND running <= 900)""")
def lead_budget_prefix(spark, d):
    return agg.within_budget(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), 900, 4).select("conv_id", "turn")


@query("""
WITH p AS (SELECT DISTINCT p_brand FROM part), x AS (SELECT n_name, r_name, p_brand FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN p)
SELECT r_name, n_name, p_brand, sha256('{"brand":"' || p_brand || '","market":"' || n_name || '"}')[1:24] AS item_hash, row_number() OVER (ORDER BY r_name, n_name, p_brand) AS position FROM x WHERE r_name <> 'AFRICA'""")
def plan_cross_product(spark, d):
    """Plan items from small dimensions: markets of the wanted regions times vocabulary."""
    markets = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'AFRICA'").select("r_name", "n_name")
    items = markets.crossJoin(table(spark, d, "part").select("p_brand").distinct())
    return items.select("r_name", "n_name", "p_brand", ids.content_id("", 24, market=F.col("n_name"), brand=F.col("p_brand")).alias("item_hash"), F.row_number().over(Window.orderBy("r_name", "n_name", "p_brand")).alias("position"))


# ---- text


@query("""
SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS places FROM documents""")
def overlapping_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrence_count(F.col("text"), "th").cast("long").alias("places"))


@query("""
SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(left(c, 79)) || '…' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)""")
def clipped_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


# ---- entities


def _records(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").count()
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") != "N").alias("dated"), F.when(F.col("l_quantity") < 25, F.col("l_suppkey")).alias("asset"))
    items = dealt(items, n, "l_orderkey")
    o = dealt(table(spark, d, "orders").drop("o_totalprice"), n, "o_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("lifecycle_step"), F.date_format("o_orderdate", "yyyy-MM").alias("occurrence_context"),
        F.when(F.col("dated"), _day(F.col("o_orderdate"))).alias("occurrence_date"), F.col("o_custkey").cast("string").alias("subject"),
        F.col("asset").cast("string").alias("asset"), F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("location"),
    )


_FACTS = """
r AS (SELECT o_orderkey * 10 + l_linenumber AS id, lower(o_orderpriority) AS a, lower(o_orderstatus) AS s, strftime(o_orderdate, '%Y-%m') AS c, CASE WHEN l_returnflag <> 'N' THEN o_orderdate::DATE END AS day,
  o_custkey::VARCHAR AS subject, CASE WHEN l_quantity < 25 THEN l_suppkey::VARCHAR END AS asset FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT DISTINCT x.id AS left_id, y.id AS right_id FROM r x JOIN r y ON x.a = y.a AND x.s = y.s AND x.c = y.c AND x.id < y.id
  WHERE x.subject = y.subject AND (x.asset IS NULL OR y.asset IS NULL OR x.asset = y.asset) AND (x.day IS NULL OR y.day IS NULL OR x.day = y.day))"""


@query(f"WITH {_FACTS} SELECT left_id, right_id FROM p")
def fact_pairs(spark, d):
    return entities.fact_pairs(_records(spark, d), rows=table(spark, d, "lineitem").count())


@query(f"""
WITH RECURSIVE {_FACTS}, e AS (SELECT left_id AS a, right_id AS b FROM p UNION SELECT right_id, left_id FROM p),
walk AS (SELECT a AS node, a AS seen FROM e UNION SELECT node, b FROM walk JOIN e ON seen = a)
SELECT node, min(seen) AS root FROM walk GROUP BY node""")
def connected_components(spark, d):
    return entities.fact_components(_records(spark, d), table(spark, d, "lineitem").count())


_CLASSES = """
k AS (SELECT DISTINCT *, list_transform([a, s, c, subject, coalesce(asset, ''), '', '', '', coalesce(day::VARCHAR, '')], lambda v: length(v) || ':' || v) AS told FROM r),
classed AS (SELECT * EXCLUDE (told), sha256(list_aggregate(told, 'string_agg', '')) AS class_id FROM k)"""


@query(f"WITH {_FACTS}, {_CLASSES} SELECT id AS candidate_id, class_id FROM classed")
def fact_classes(spark, d):
    return entities.class_members(_records(spark, d), table(spark, d, "lineitem").count())


@query(f"""
WITH {_FACTS}, {_CLASSES}, f AS (SELECT DISTINCT * EXCLUDE (id) FROM classed)
SELECT x.class_id AS left_class, y.class_id AS right_class FROM f x JOIN f y ON x.a = y.a AND x.s = y.s AND x.c = y.c AND x.subject = y.subject AND x.class_id < y.class_id
WHERE (x.asset IS NULL OR y.asset IS NULL OR x.asset = y.asset) AND (x.day IS NULL OR y.day IS NULL OR x.day = y.day)""")
def fact_class_pairs(spark, d):
    return entities.fact_class_pairs(entities.classed(_records(spark, d)), table(spark, d, "lineitem").count())


_GREEDY = """
i AS (SELECT DISTINCT ON (id) l_orderkey * 10 + l_linenumber AS id, l_orderkey || ':' || l_partkey AS source, l_suppkey FROM lineitem ORDER BY id, l_partkey, l_suppkey),
g AS (SELECT id, CASE WHEN s_acctbal > 5000 THEN n_regionkey END AS region FROM i JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
every AS (SELECT left_id, right_id FROM p UNION SELECT a.id, b.id FROM i a JOIN i b ON b.id = a.id + 1 WHERE a.id % 50 IN (1, 3)
  UNION SELECT a.id, b.id FROM i a JOIN i b ON a.source = b.source AND a.id < b.id),
same AS (SELECT left_id, right_id FROM every JOIN g a ON a.id = left_id JOIN g b ON b.id = right_id WHERE coalesce(a.region = b.region, true)),
e AS (SELECT left_id AS a, right_id AS b FROM same UNION SELECT right_id, left_id FROM same),
walk AS (SELECT a AS node, a AS seen FROM e UNION SELECT node, b FROM walk JOIN e ON seen = a),
roots AS (SELECT node, min(seen) AS root FROM walk GROUP BY node),
placed AS (SELECT root, node AS id, row_number() OVER (PARTITION BY root ORDER BY node) AS pos, (SELECT list(b) FROM e WHERE e.a = node) AS near FROM roots),
steps AS (
  SELECT root, 0::BIGINT AS pos, []::BIGINT[][] AS groups FROM placed WHERE pos = 1
  UNION ALL SELECT root, pos, CASE WHEN len(fits) = 0 THEN list_append(groups, [id])
    ELSE list_transform(groups, lambda x: CASE WHEN x[1] = list_filter(fits, lambda y: list_min(y) = list_min(list_transform(fits, lambda z: list_min(z))))[1][1] THEN list_append(x, id) ELSE x END) END
  FROM (SELECT t.root, t.pos, t.id, groups, list_filter(groups, lambda x: list_has_all(near, x)) AS fits FROM steps s JOIN placed t ON t.root = s.root AND t.pos = s.pos + 1)),
last AS (SELECT arg_max(groups, pos) AS groups FROM steps GROUP BY root)"""


@query(f"""
WITH RECURSIVE {_FACTS}, {_GREEDY}, found AS (SELECT unnest(groups) AS members FROM last)
SELECT unnest(members) AS candidate_id, list_min(members) AS group_id FROM found UNION ALL SELECT id, id FROM i WHERE id NOT IN (SELECT node FROM roots)""")
def complete_link_groups(spark, d):
    """Line items as records: suppliers of different regions keep pairs apart, equal sources, equal facts and
    agreed proposals (here neighbours by id) put them together."""
    first = F.min(F.struct("l_partkey", "l_suppkey")).alias("x")
    items = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), "l_orderkey").agg(first).select("candidate_id", F.concat_ws(":", "l_orderkey", "x.l_partkey").alias("source"), "x.l_suppkey")
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_acctbal") > 5000, F.col("n_regionkey")).alias("region_id"))
    proposed = items.where("candidate_id % 50 in (1, 3)").select(F.col("candidate_id").alias("left_id"), (F.col("candidate_id") + 1).alias("right_id"))
    records = items.join(places, "l_suppkey").select("candidate_id", F.col("candidate_id").alias("order_key"), "source", F.col("region_id").alias("region"))
    # regions are known of the records, so conflicts need no pairs; what names a pair first doesn't matter here
    facts = entities.fact_pairs(_records(spark, d), rows=table(spark, d, "lineitem").count(), once=False)
    return entities.complete_link_groups(records, facts.unionByName(proposed).withColumn("relation", F.lit("SAME_EVENT")))


# ---- pages


@query()
def principal_document(spark, d):
    return html.principal_documents(table(spark, d, "pages")).select("page_id", "status", "boundary", "title", "headline", F.length("body").alias("body_chars"), F.size("dates").alias("n_dates"))


@query("""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, trim(regexp_replace(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '\\s+', ' ', 'g'))
  = trim(regexp_replace(lower(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)), '\\s+', ' ', 'g')) AS repeated FROM pages""")
def headline_and_title(spark, d):
    title, head = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return table(spark, d, "pages").select("page_id", title.alias("title"), (text.lookup_key(title) == text.lookup_key(head)).alias("repeated"))
