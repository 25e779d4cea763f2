"""Queries of reports, audits and rules across tables; orders are candidates, a customer's orders of a week events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import audit, proposals, report
from ..sources.tables import table
from ._register import duck, given, query

_CAND = "SELECT o_orderkey AS candidate_id, o_custkey FROM {orders}"
_EVID = "SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'P' THEN 'REJECTED' ELSE 'READY' END AS state FROM {orders}"
_SCOP = "SELECT o_orderkey AS candidate_id, CASE WHEN o_totalprice > 100000 THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS scope FROM {orders} WHERE o_orderkey % 10 <> 3"
_TEMP = "SELECT o_orderkey AS candidate_id, o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AS date_valid FROM {orders}"


@query("SELECT o_orderkey AS candidate_id, o_custkey, 'READY' AS state, 'IN_SCOPE' AS scope, true AS date_valid FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 AND o_orderkey % 10 <> 3 AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
def identity_records(spark, d):
    """Candidates with ready evidence, in scope and dated in the period."""
    return report.evidence_of(*(given(spark, d, s) for s in (_CAND, _EVID, _SCOP, _TEMP)))


_META = """SELECT l_orderkey AS event_id, l_linenumber = 1 AS canonical, r_name AS region_id, CASE s_suppkey % 3 WHEN 0 THEN 'SOURCE_STATED' WHEN 1 THEN 'REFERENCE_MAPPED' ELSE 'UNRESOLVED' END AS basis, n_name AS location, 'S' || CAST(l_partkey % 2 AS STRING) AS system, l_orderkey % 9 = 0 AS monitored
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
_AGREED = f"""
m AS ({duck(_META)}), g AS (SELECT event_id, count(DISTINCT CASE WHEN basis <> 'UNRESOLVED' THEN region_id END) AS n, min(CASE WHEN basis <> 'UNRESOLVED' THEN region_id END) AS region, bool_or(basis = 'SOURCE_STATED') AS said, bool_and(monitored) AS monitored,
  count(DISTINCT location) AS places, min(location) AS location, count(DISTINCT system) AS systems, min(system) AS one, max(CASE WHEN canonical THEN system END) AS own FROM m GROUP BY 1),
x AS (SELECT *, CASE WHEN monitored THEN NULL WHEN n > 1 THEN 'REGION_CONFLICT' WHEN n = 0 THEN 'REGION_NOT_ESTABLISHED' WHEN region NOT IN ('ASIA', 'EUROPE') THEN 'REGION_NOT_DESIGNATED' END AS reason FROM g)"""


def _metadata(spark, d):
    allowed = table(spark, d, "region").where("r_name in ('ASIA', 'EUROPE')").select(F.col("r_name").alias("region_id"))
    return report.formal_metadata(given(spark, d, _META), allowed)


@query(f"""
WITH {_AGREED} SELECT event_id, CASE WHEN n = 1 THEN region END AS region_id, CASE WHEN n = 1 THEN CASE WHEN said THEN 'SOURCE_STATED' ELSE 'REFERENCE_MAPPED' END END AS region_basis, CASE WHEN places = 1 THEN location END AS location,
  CASE WHEN systems = 1 THEN one ELSE own END AS system FROM x WHERE reason IS NULL""")
def formal_metadata(spark, d):
    return _metadata(spark, d)[0]


@query(f"WITH {_AGREED} SELECT event_id, reason FROM x WHERE reason IS NOT NULL")
def metadata_exclusions(spark, d):
    return _metadata(spark, d)[1]


@query(f"WITH {_AGREED} SELECT event_id, CASE WHEN systems = 1 THEN one ELSE own END AS value, CASE WHEN systems = 0 THEN 'NOT_STATED' WHEN systems = 1 THEN 'NONE' WHEN own IS NOT NULL THEN 'CANONICAL_MEMBER' ELSE 'CONFLICT' END AS diagnostic FROM x")
def agreed_systems(spark, d):
    """The system of an event: what all members say, else what the canonical member says."""
    return report.agreed_value(given(spark, d, _META), "system")


_BLOCKS = "SELECT l_orderkey AS event_id, l_linenumber AS attempt, 'H' || CAST(max(l_partkey) AS STRING) AS headline, 'P' || CAST(max(l_suppkey) AS STRING) AS prose FROM {lineitem} WHERE l_linenumber > 1 GROUP BY l_orderkey, l_linenumber"


@query(f"WITH b AS ({duck(_BLOCKS)}) SELECT event_id, o_custkey, arg_max(headline, attempt) AS headline, arg_max(prose, attempt) AS prose FROM b JOIN orders ON o_orderkey = event_id GROUP BY 1, 2")
def written_blocks(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey")
    return report.written_blocks(events, given(spark, d, _BLOCKS))[0]


@query("SELECT 'Writer' AS stage, o_orderkey AS subject_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 1)")
def writer_gaps(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey")
    return report.written_blocks(events, given(spark, d, _BLOCKS))[1]


@query("""
WITH b AS (SELECT DISTINCT l_orderkey AS event_id, l_linenumber AS attempt FROM lineitem WHERE l_linenumber <= 2), f AS (SELECT DISTINCT l_orderkey AS event_id, l_linenumber AS attempt FROM lineitem WHERE l_quantity > 30)
SELECT b.event_id AS event_id, coalesce(min(CASE WHEN f.event_id IS NULL THEN b.attempt END), max(b.attempt)) AS attempt, bool_or(f.event_id IS NULL) AS valid FROM b LEFT JOIN f ON b.event_id = f.event_id AND b.attempt = f.attempt GROUP BY 1""")
def validated_blocks(spark, d):
    """The deciding block of each event: the first of at most two without a finding."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("attempt"), "l_quantity")
    return report.validated(items.select("event_id", "attempt").distinct(), items.where("l_quantity > 30"))


_ENTRIES = """SELECT CAST(o_custkey AS STRING) AS report, CASE o_orderkey % 5 WHEN 0 THEN 'INCIDENT' WHEN 1 THEN 'PROCUREMENT' WHEN 2 THEN 'NORMATIVE_CHANGE' WHEN 3 THEN 'OPERATIONAL_CHANGE' ELSE 'TECHNICAL_DEVELOPMENT' END AS section,
  o_orderkey % 100 AS position, o_orderkey AS event_id, 'H' || CAST(o_orderkey AS STRING) AS headline, o_orderpriority AS prose, 'src [' || o_orderstatus || ']' AS source, 'https://h/' || CAST(o_orderkey AS STRING) AS url FROM {orders}"""


@query(rf"""
WITH e AS ({duck(_ENTRIES)}), p AS (SELECT *, list_position(['TECHNICAL_DEVELOPMENT', 'INCIDENT', 'OPERATIONAL_CHANGE', 'PROCUREMENT', 'NORMATIVE_CHANGE'], section) AS place, row_number() OVER (PARTITION BY report, section ORDER BY position, event_id) AS k FROM e)
SELECT report, sha256('{{"events":[' || string_agg(event_id, ',' ORDER BY place, position, event_id) || ']}}')[1:16] AS report_id,
  string_agg(CASE WHEN k = 1 THEN '## ' || section || chr(10) || chr(10) ELSE '' END || '### ' || headline || chr(10) || chr(10) || prose || chr(10) || chr(10) || '[' || replace(replace(source, '[', '\['), ']', '\]') || '](' || url || ')', chr(10) || chr(10) ORDER BY place, position, event_id) AS text FROM p GROUP BY report""")
def assembled_reports(spark, d):
    """A report for each customer, sections in their order."""
    return report.assembled(given(spark, d, _ENTRIES), "report")


@query("""
SELECT l_orderkey, concat_ws(' ', CASE WHEN count(*) FILTER (l_quantity > 45) > 0 THEN count(*) FILTER (l_quantity > 45) || ' out of range.' END, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN count(*) FILTER (l_returnflag = 'R') || ' excluded.' END) AS note FROM lineitem GROUP BY 1""")
def disclosure_notes(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 45).alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return counts.select("l_orderkey", report.disclosure({"out of range": F.col("a"), "excluded": F.col("b")}).alias("note"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS summary FROM c GROUP BY 1""")
def run_summary(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return report.summary_line(counts, "user_id", "event_type", "n")


@query("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders QUALIFY place IN (1, 10, 60, 65, 115, 122)")
def health_probes(spark, d):
    return report.probes(table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


# ---- audit


@query("""
SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'P' THEN 'CATEGORY' WHEN o_orderkey % 7 = 0 THEN 'TAXONOMY' WHEN o_orderkey % 5 = 0 THEN 'METADATA' WHEN o_orderkey % 3 = 0 THEN 'WRITER' ELSE 'FINAL_REPORT' END AS stage,
  CASE WHEN o_orderstatus = 'P' THEN 'UNRESOLVED' WHEN o_orderkey % 7 = 0 THEN 'CONFLICT' WHEN o_orderkey % 5 = 0 THEN 'REGION_CONFLICT' WHEN o_orderkey % 3 = 0 THEN 'GAP' ELSE 'INCLUDED' END AS reason FROM orders""")
def event_outcomes(spark, d):
    """The stage that ended each event, by a star of left joins."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_orderstatus")
    ended = lambda where, why: orders.where(where).select("event_id", F.lit(why).alias("reason"))
    return audit.outcomes(orders, category=ended("o_orderstatus = 'P'", "UNRESOLVED"), taxonomy=ended("event_id % 7 = 0", "CONFLICT"), metadata=ended("event_id % 5 = 0", "REGION_CONFLICT"), writer=ended("event_id % 3 = 0", "GAP"))


@query(f"""
SELECT o_orderkey AS event_id, -list_position({list(audit.STAGES)!r}, CASE WHEN o_orderstatus = 'P' THEN 'CATEGORY' ELSE 'FINAL_REPORT' END) AS stage_key, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END, 1000000) AS position_key FROM orders""")
def audit_order(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "P", "CATEGORY").otherwise("FINAL_REPORT").alias("stage"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("position"))
    return audit.audit_order(rows).select("event_id", "stage_key", "position_key")


@query("""
WITH e AS (SELECT l_orderkey AS c, l_returnflag AS reason FROM lineitem UNION ALL SELECT l_partkey, l_returnflag FROM lineitem) SELECT c AS candidate_id, reason, count(*) AS n FROM e GROUP BY 1, 2""")
def pair_diagnostics(spark, d):
    return audit.pair_diagnostics(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"), F.col("l_returnflag").alias("reason")))


@query("SELECT l_orderkey, string_agg('r:' || l_partkey || '=' || l_returnflag, ' ' ORDER BY 'r:' || l_partkey, l_returnflag) AS members FROM lineitem GROUP BY 1")
def rejected_members(spark, d):
    details = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("r:"), "l_partkey", F.lit(":"), "l_returnflag")).alias("x"))
    return details.select("l_orderkey", F.array_join(F.transform(audit.rejected_members(F.col("x")), lambda m: F.concat(m["member"], F.lit("="), m["reason"])), " ").alias("members"))


@query("SELECT 'Scope:' || p_brand || ':' || CASE WHEN regexp_matches(p_type, '^[A-Za-z0-9_.:/-]{1,96}$') THEN p_type ELSE 'UNKNOWN' END AS signature, count(*) AS n FROM part GROUP BY 1")
def gap_histogram(spark, d):
    return audit.gap_histogram(table(spark, d, "part").select(F.lit("Scope").alias("stage"), F.col("p_brand").alias("kind"), F.col("p_type").alias("detail")))


@query("SELECT event_type AS stage, CASE WHEN (event_type = 'click' AND k IN ('0', '1')) OR (event_type = 'view' AND k IN ('2')) THEN k ELSE 'UNKNOWN' END AS fact, count(*) AS n FROM (SELECT event_type, (event_id % 4)::VARCHAR AS k FROM events) GROUP BY 1, 2")
def stage_facts(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("event_id") % 4).cast("string").alias("fact"))
    return audit.stage_facts(rows, "stage", "fact", {"click": ("0", "1"), "view": ("2",)})


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'v' WHEN page_id % 11 + 1 < 7 THEN 'NOT_REACHED' END AS field FROM pages")
def field_states(spark, d):
    gate = F.element_at(F.array(*[F.lit(g) for g in proposals.GATES]), (F.col("page_id") % 11 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", audit.field_state(F.when(F.col("page_id") % 3 == 0, "v"), proposals.gate_order(gate), proposals.GATES.index("PRINCIPAL_DOCUMENT") + 1).alias("field"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::INTEGER AS chars, CASE WHEN length(c) <= 40 THEN c ELSE rtrim(left(c, 39)) || '…' END AS excerpt FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def evidence_projections(spark, d):
    return table(spark, d, "documents").select("doc_id", audit.evidence_projection(F.col("text"), 40).alias("e")).select("doc_id", "e.*")


_GAPS = "SELECT CASE l_linenumber % 2 WHEN 0 THEN 'EventIdentity' ELSE 'Scope' END AS stage, l_partkey AS subject_id, l_returnflag AS kind FROM {lineitem}"


@query(f"""
WITH g AS ({duck(_GAPS)}) SELECT stage, subject_id FROM g GROUP BY stage, subject_id, CASE WHEN stage = 'EventIdentity' THEN kind END HAVING count(*) > 1""")
def repeated_gaps(spark, d):
    return audit.repeated_gaps(given(spark, d, _GAPS))


@query("""
SELECT o_orderkey AS event_id, 'NO_RESULT' AS fault FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20) AND o_orderkey % 4 > 0
UNION ALL SELECT l_orderkey, 'NO_INPUT' FROM lineitem WHERE l_quantity > 20 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'ZZ')""")
def result_coverage(spark, d):
    orders = table(spark, d, "orders")
    results = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("event_id"))
    return audit.uncovered(orders.select(F.col("o_orderkey").alias("event_id")), results, orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("subject_id")), "event_id")


_OBS = "SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity > 5 AS attempted, CASE l_linenumber % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'ZERO_RESULTS' ELSE 'SUCCESS_WITH_RESULTS' END AS terminal, CASE WHEN l_partkey % 3 = 0 THEN 'RATE_LIMIT' END AS failure, l_suppkey % 3 AS results FROM {lineitem}"


@query(f"""
WITH o AS ({duck(_OBS)}) SELECT k, 'NOT_ATTEMPTED_HAS_NO_RESULT' AS rule FROM o WHERE NOT (attempted OR (results = 0 AND failure IS NULL)) UNION ALL SELECT k, 'FAILURE_HAS_REASON' FROM o WHERE terminal = 'FAILED' AND failure IS NULL
UNION ALL SELECT k, 'SUCCESS_HAS_NO_REASON' FROM o WHERE terminal <> 'FAILED' AND failure IS NOT NULL UNION ALL SELECT k, 'ZERO_RESULTS' FROM o WHERE terminal = 'ZERO_RESULTS' AND results <> 0 UNION ALL SELECT k, 'RESULTS' FROM o WHERE terminal = 'SUCCESS_WITH_RESULTS' AND results = 0""")
def observation_rules(spark, d):
    return audit.broken_rules(given(spark, d, _OBS), "k", **audit.observation_rules())


@query("""
WITH e AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'REJECTED' ELSE 'READY' END AS state, CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE text END AS content, CASE WHEN doc_id % 4 = 0 THEN 'TITLE_ONLY' END AS reason, CASE WHEN doc_id % 2 = 0 THEN substr(text, 3, 4) END AS value, 1 + doc_id % 3 AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'READY_HAS_CONTENT' AS rule FROM e WHERE state = 'READY' AND trim(content, ' ') = '' UNION ALL SELECT doc_id, 'READY_HAS_NO_REASON' FROM e WHERE state = 'READY' AND reason IS NOT NULL
UNION ALL SELECT doc_id, 'REJECTED_HAS_REASON' FROM e WHERE state = 'REJECTED' AND reason IS NULL UNION ALL SELECT doc_id, 'VALUE_IN_SPAN' FROM e WHERE value IS NOT NULL AND NOT contains(substr(content, (s + 1)::INTEGER, 6), value)""")
def evidence_rules(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").where("text is not null").select(
        k, F.when(k % 3 == 0, "REJECTED").otherwise("READY").alias("state"), F.when(k % 10 == 0, " ").otherwise(F.col("text")).alias("content"), F.when(k % 4 == 0, "TITLE_ONLY").alias("reason"),
        F.when(k % 2 == 0, F.substring("text", 3, 4)).alias("value"), (1 + k % 3).cast("int").alias("start"), (7 + k % 3).cast("int").alias("end"),
    )
    return audit.broken_rules(rows, "doc_id", **audit.evidence_rules())


_OEVENTS = "SELECT l_orderkey AS event_id, min(l_partkey) + CASE WHEN l_orderkey % 7 = 0 THEN 1000000 ELSE 0 END AS canonical_id, count(DISTINCT l_partkey) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS members, CASE WHEN l_orderkey % 3 > 0 THEN max(CAST(l_shipdate AS DATE)) END AS day FROM {lineitem} GROUP BY l_orderkey"


@query(f"""
WITH e AS ({duck(_OEVENTS)}) SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'REPEATED_EVENT' WHEN event_id % 5 = 0 THEN 'MEMBERS' WHEN event_id % 7 = 0 THEN 'CANONICAL' ELSE 'DATE' END AS fault FROM e WHERE event_id % 11 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 3 = 0""")
def ordering_faults(spark, d):
    events = given(spark, d, _OEVENTS)
    twice = events.unionByName(events.where("event_id % 11 = 0"))
    return audit.ordering_faults(twice, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("candidate_id")))


def _families(spark, d):
    rows = table(spark, d, "part").where("p_size > 40").groupBy(F.concat(F.lit("EN "), F.col("p_partkey") % 25).alias("parent")).agg(F.array_sort(F.collect_set(F.concat(F.lit("EN "), F.col("p_partkey") % 60, F.lit("-1")))).alias("children"))
    listed = table(spark, d, "part").select(F.concat(F.lit("EN "), F.col("p_partkey") % 20).alias("publication")).distinct()
    return listed.unionByName(listed.where("publication = 'EN 7'").select(F.concat("publication", F.lit("-1")).alias("publication"))), rows


_FAMILIES = """
fm AS (SELECT DISTINCT 'EN ' || (p_partkey % 25) AS parent, 'EN ' || (p_partkey % 60) || '-1' AS child FROM part WHERE p_size > 40),
pb AS (SELECT DISTINCT 'EN ' || (p_partkey % 20) AS publication FROM part UNION SELECT 'EN 7-1')"""


@query(f"WITH {_FAMILIES} SELECT child AS publication, parent AS owner FROM fm UNION ALL SELECT publication, publication FROM pb WHERE publication NOT IN (SELECT child FROM fm)")
def identifier_owners(spark, d):
    return audit.owners(*_families(spark, d))


@query(f"""
WITH {_FAMILIES} SELECT DISTINCT parent AS publication, 'PARENT_NOT_LISTED' AS fault FROM fm WHERE parent NOT IN (SELECT publication FROM pb) UNION ALL SELECT DISTINCT child, 'CHILD_LISTED' FROM fm WHERE child IN (SELECT publication FROM pb)
UNION ALL SELECT child, 'TWO_PARENTS' FROM fm GROUP BY child HAVING count(DISTINCT parent) > 1""")
def family_faults(spark, d):
    return audit.family_faults(*_families(spark, d))


_SAID = "SELECT l_orderkey * 10 + l_linenumber AS k, 'see EN ' || CAST(l_partkey % 30 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '-1:2019' ELSE '' END || ', ＩＥＣ　６２２９０ and EN 5x or XEN 9' AS said FROM {lineitem}"


@query(f"WITH s AS ({duck(_SAID)}) SELECT k, 'EN ' || regexp_extract(said, 'EN (\\d+)', 1) || CASE WHEN k % 2 = 0 THEN '-1:2019' ELSE '' END || '|IEC 62290' AS identifiers FROM s".replace("CASE WHEN k % 2", "CASE WHEN (k % 10) % 2"))
def stated_identifiers(spark, d):
    """Identifiers in texts, full-width ones in their plain form, none inside other words."""
    return given(spark, d, _SAID).select("k", F.array_join(audit.identifiers(F.col("said"), ("EN", "IEC")), "|").alias("identifiers"))


@query(f"""
WITH {_FAMILIES}, ow AS (SELECT publication, min(owner) AS owner FROM (SELECT child AS publication, parent AS owner FROM fm UNION ALL SELECT publication, publication FROM pb WHERE publication NOT IN (SELECT child FROM fm)) GROUP BY 1),
i AS (SELECT DISTINCT 'EN ' || (l_partkey % 70) || CASE l_linenumber % 3 WHEN 0 THEN '-1:2019' WHEN 1 THEN '-1' ELSE '' END AS identifier FROM lineitem)
SELECT identifier, coalesce(a.owner, b.owner) AS owner FROM i LEFT JOIN ow a ON a.publication = identifier LEFT JOIN ow b ON b.publication = regexp_replace(identifier, ':\\d{{4}}$', '')""")
def owned_identifiers(spark, d):
    owner_of = audit.owners(*_families(spark, d)).groupBy("publication").agg(F.min("owner").alias("owner"))
    year = F.element_at(F.array(F.lit("-1:2019"), F.lit("-1"), F.lit("")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return audit.owned(table(spark, d, "lineitem").select(F.concat(F.lit("EN "), F.col("l_partkey") % 70, year).alias("identifier")).distinct(), owner_of)


@query("""
WITH c AS (SELECT p_brand FROM part WHERE p_size = 3 GROUP BY 1 UNION ALL SELECT DISTINCT p_brand FROM part WHERE p_size = 7), t AS (SELECT p_brand, count(*) AS times FROM c GROUP BY 1)
SELECT p_brand, coalesce(times, 0) AS times FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN t USING (p_brand) WHERE coalesce(times, 0) <> 1""")
def catalogue_coverage(spark, d):
    part = table(spark, d, "part")
    return audit.coverage(part, part.where("p_size = 3").select("p_brand").distinct(), part.where("p_size = 7").select("p_brand").distinct(), "p_brand")


@query("""
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2024-01-05T10:00:00+08:00' WHEN 1 THEN '2024-01-05 10:00 [Asia/Taipei]' WHEN 2 THEN '2024-01-05T10:00:00Z' ELSE '2024-01-05' END AS raw FROM pages)
SELECT page_id, ['+08:00', '[Asia/Taipei]', 'Z', NULL][page_id % 4 + 1] AS zone, page_id % 3 > 0 AS valid FROM p""")
def stated_zones(spark, d):
    k = F.col("page_id")
    raw = F.when(k % 4 == 0, "2024-01-05T10:00:00+08:00").when(k % 4 == 1, "2024-01-05 10:00 [Asia/Taipei]").when(k % 4 == 2, "2024-01-05T10:00:00Z").otherwise("2024-01-05")
    end = F.when(k % 3 > 0, F.lit("2024-01-07")).otherwise("2024-01-01").cast("date")
    return table(spark, d, "pages").select(k, dates.zone_of(raw).alias("zone"), dates.valid_period(F.lit("2024-01-05").cast("date"), end).alias("valid"))


@query("SELECT max(length(text)) <= 100000000 AS bounded FROM documents")
def bounded_audit(spark, d):
    return audit.bounded(table(spark, d, "documents"), "text", 100_000_000)


_STEPS = ("search_plan", "search_attempts", "search_unattempted", "evidence_results", "technical_gaps_evidence", "temporal_results", "event_identity_records", "category_results", "technical_gaps_category",
          "ordered_results", "formal_metadata", "metadata_exclusions", "writer_blocks", "validation_passed", "validation_failed", "final_report_events", "technical_gaps")
_STEP = "CASE o_orderkey % 17 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STEPS)) + " END"
# every third run has no categories, every seventh no evidence
_COUNTS = f"""SELECT run_id, stage, count(*) AS n FROM (SELECT o_custkey % 50 AS run_id, {_STEP} AS stage FROM {{orders}})
WHERE NOT (stage = 'category_results' AND run_id % 3 = 0) AND NOT (stage = 'evidence_results' AND run_id % 7 = 0) GROUP BY 1, 2"""
_REASONS = """SELECT o_custkey % 50 AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'search_failure' WHEN 1 THEN 'evidence_reason' ELSE 'evidence_gate' END AS kind, o_orderpriority || CAST(o_orderkey % 5 AS STRING) AS reason, CAST(o_orderkey % 4 + 1 AS BIGINT) AS n FROM {orders} WHERE o_orderstatus <> 'F'"""


@query(f"""
WITH c AS ({duck(_COUNTS)}), r AS (SELECT run_id, kind, reason, sum(n) AS n FROM ({duck(_REASONS)}) GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id, kind ORDER BY n DESC, reason) AS place FROM r),
x AS (SELECT run_id, sum(n) FILTER (kind = 'search_failure') AS failed, string_agg(reason || '=' || CAST(n AS BIGINT), '; ' ORDER BY place) FILTER (kind = 'evidence_reason' AND place <= 5) AS reasons,
  string_agg(reason || '=' || CAST(n AS BIGINT), '; ' ORDER BY place) FILTER (kind = 'evidence_gate' AND place <= 5) AS gates FROM t GROUP BY 1),
p AS (SELECT run_id, {", ".join(f"CAST(sum(n) FILTER (stage = '{s}') AS BIGINT) AS s_{s}" for s in _STEPS)} FROM c GROUP BY 1)
SELECT run_id, s_search_plan AS planned, s_search_attempts AS attempted, s_search_unattempted AS unattempted, s_temporal_results AS in_scope, s_event_identity_records AS records, s_category_results AS categorized, s_ordered_results AS reportable,
  s_formal_metadata AS formal_metadata, s_metadata_exclusions AS metadata_exclusions, s_writer_blocks AS generated, s_validation_passed AS validated, s_validation_failed AS validation_failed, s_final_report_events AS final_report_events,
  s_evidence_results + coalesce(s_technical_gaps_evidence, 0) AS discovered, s_category_results + coalesce(s_technical_gaps_category, 0) AS events, coalesce(s_technical_gaps, 0) AS technical_gaps,
  CAST(coalesce(failed, 0) AS BIGINT) AS technical_failures, coalesce(failed, 0) > 0 AS degraded, coalesce(reasons, '') AS top_evidence_reasons, coalesce(gates, '') AS top_evidence_gates
FROM p LEFT JOIN x USING (run_id)""")
def engineering_summary(spark, d):
    """Orders stand for counted records and reasons, their customers are dealt to fifty runs."""
    return report.engineering_summary(given(spark, d, _COUNTS), given(spark, d, _REASONS))
