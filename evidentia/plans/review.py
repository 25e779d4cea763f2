"""Queries of checks on recorded proposals; line items stand for answers, orders for events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segments, text
from ..operators import proposals, review
from ..sources.tables import table
from ._register import duck, given, query


def _first(*named: tuple[str, str]) -> str:
    """CASE that names the first condition that isn't true."""
    return "CASE " + " ".join(f"WHEN NOT coalesce({good}, false) THEN '{name}'" for name, good in named) + " END"


_SCOPES = """SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_linenumber = 7 THEN 'MAYBE' WHEN l_linenumber % 2 = 0 THEN 'IN_SCOPE' ELSE 'OUT_OF_SCOPE' END AS state,
  CASE WHEN l_partkey % 9 = 0 THEN 'ODD' WHEN l_linenumber % 2 = 0 OR l_partkey % 7 = 0 THEN 'NONE' ELSE 'NON_URBAN_RAIL' END AS diagnostic, l_discount * 12 AS confidence, CAST(l_quantity AS INT) AS a, l_suppkey % 4 AS n,
  'The Line ' || CAST(l_suppkey % 5 AS STRING) || ' opens' AS relation, 'on LINE ' || CAST(l_suppkey % 3 AS STRING) || ' today' AS focus_text, 'line ' || CAST(l_suppkey % 3 AS STRING) AS endpoint FROM {lineitem}"""


@query(f"""
WITH s AS ({duck(_SCOPES)}), v AS (SELECT k, state, {_first(("STATE", "state IN ('IN_SCOPE', 'OUT_OF_SCOPE')"), ("DIAGNOSTIC", "diagnostic <> 'ODD'"), ("STATE_DIAGNOSTIC", "(state = 'IN_SCOPE') = (diagnostic = 'NONE')"),
  ("CONFIDENCE", "confidence BETWEEN 0 AND 1"), ("CITATION", "n > 0"), ("DUPLICATE_CITATION", "n < 3"), ("FOCUS", "state <> 'IN_SCOPE' OR a % 8 > 0"), ("OUTSIDE_FOCUS", "state <> 'IN_SCOPE' OR (a >= 10 AND a + 5 <= 45)"),
  ("ENDPOINTS", "state <> 'IN_SCOPE' OR contains(lower(relation), endpoint)"))} AS violation FROM s)
SELECT k, violation, CASE WHEN violation IS NULL THEN state ELSE 'SCOPE_NOT_ESTABLISHED' END AS scope FROM v""")
def scope_proposals(spark, d):
    """Scope answers and the first rule that each breaks, from the shape of the answer to spans and endpoints."""
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    rows = given(spark, d, _SCOPES)
    none = F.array().cast("array<struct<start:int,end:int>>")
    cited = F.when(F.col("n") == 0, none).when(F.col("n") == 3, F.array(span(F.col("a"), F.col("a") + 5), span(F.col("a"), F.col("a") + 5))).otherwise(F.array(span(F.col("a"), F.col("a") + 5)))
    focus = F.when(F.col("a") % 8 == 0, none).otherwise(F.array(span(F.lit(30), F.lit(45)), span(F.lit(10), F.lit(20))))
    found = review.scope(rows.withColumn("cited", cited).withColumn("focus", focus).withColumn("endpoints", F.array("endpoint")))
    return found.select("k", "violation", "scope")


_CATEGORIES = """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'ODD' WHEN o_orderstatus = 'F' THEN 'ASSIGNED' ELSE 'UNRESOLVED' END AS state, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 > 0 THEN o_orderpriority END AS category_id,
  CASE WHEN o_orderstatus <> 'F' THEN 'no evidence' END AS reason, CASE WHEN o_orderkey % 5 = 0 THEN 'Bad subtype' ELSE 'good_subtype' END AS subtype, o_orderkey % 3 AS n FROM {orders}"""


@query(f"""
WITH c AS ({duck(_CATEGORIES)}) SELECT event_id, {_first(("STATE", "state IN ('ASSIGNED', 'UNRESOLVED')"), ("SHAPE", "(state = 'ASSIGNED' AND category_id IS NOT NULL AND reason IS NULL) OR (state <> 'ASSIGNED' AND category_id IS NULL AND reason IS NOT NULL)"),
  ("SUBTYPE", "state <> 'ASSIGNED' OR subtype = 'good_subtype'"), ("CITATION", "n > 0"))} AS violation FROM c""")
def category_proposals(spark, d):
    cited = F.when(F.col("n") > 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>"))
    return proposals.category(given(spark, d, _CATEGORIES).withColumn("cited", cited)).select("event_id", "violation")


@query(f"""
WITH t AS (SELECT o_orderkey AS event_id, o_orderkey % 2 = 0 AS same, o_orderkey % 3 AS c, o_orderkey % 5 = 0 AS insufficient, o_orderkey % 7 > 0 AS named FROM orders)
SELECT event_id, {_first(("SUPPORT", "same"), ("CONFLICT", "c <> 1"), ("INSUFFICIENT", "NOT insufficient OR named"))} AS violation FROM t""")
def taxonomy_proposals(spark, d):
    k, arr = F.col("o_orderkey"), lambda *v: F.array(*[F.lit(x) for x in v])
    rows = table(spark, d, "orders").select(
        k.alias("event_id"), arr("SIGNALLING", "POWER_SUPPLY").alias("assigned"), F.when(k % 2 == 0, arr("POWER_SUPPLY", "SIGNALLING", "SIGNALLING")).otherwise(arr("SIGNALLING")).alias("supported"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, arr("SIGNALLING", "SIGNALLING")).otherwise(arr("SIGNALLING", "POWER_SUPPLY")).alias("conflicting"),
        (k % 5 == 0).alias("insufficient"), F.when(k % 7 > 0, arr("a", "b")).otherwise(arr("a")).alias("named"), arr("b", "a").alias("members"),
    )
    return proposals.taxonomy(rows).select("event_id", "violation")


@query("""
WITH r AS (SELECT o_orderkey AS event_id, ['AWARD_OR_RANKING', 'OPENING', 'FEATURE_OR_BACKGROUND', 'TENDER'][o_orderkey % 4 + 1] AS occurrence, CASE WHEN o_orderkey % 5 = 0 THEN 'ODD' ELSE 'REPORTABLE' END AS proposed, o_orderkey % 6 > 0 AS all_seen FROM orders),
v AS (SELECT *, CASE WHEN NOT all_seen THEN 'MEMBERS' WHEN proposed = 'ODD' THEN 'PROPOSED' END AS violation FROM r)
SELECT event_id, violation, CASE WHEN violation IS NULL THEN CASE WHEN occurrence IN ('AWARD_OR_RANKING', 'FEATURE_OR_BACKGROUND') THEN 'NOT_REPORTABLE' ELSE proposed END END AS state FROM v""")
def reportability_proposals(spark, d):
    k = F.col("o_orderkey")
    occurrence = F.element_at(F.array(*[F.lit(x) for x in ("AWARD_OR_RANKING", "OPENING", "FEATURE_OR_BACKGROUND", "TENDER")]), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "orders").select(
        k.alias("event_id"), occurrence.alias("occurrence"), F.when(k % 5 == 0, "ODD").otherwise("REPORTABLE").alias("proposed"), F.array(F.lit(1), F.lit(2)).alias("members"), F.when(k % 6 > 0, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1))).alias("examined")
    )
    return proposals.reportability(rows).select("event_id", "violation", "state")


@query(f"""
WITH m AS (SELECT doc_id, doc_id % 3 > 0 AS supplied, doc_id % 4 > 0 AS legal, length(text) > 0 AND doc_id % 2 = 0 AS cites, text FROM documents)
SELECT doc_id AS candidate_id, {_first(("IDENTIFIER", "supplied"), ("ACTION", "legal"), ("CITATION", "cites"), ("NOT_NAMED", "contains(lower(text), 'en 1')"))} AS violation FROM m""")
def monitored_changes(spark, d):
    """Changes of monitored standards: supplied identifier, legal action, a citation that resolves and names it."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    rows = docs.select(k.alias("candidate_id"), F.lit("EN 1").alias("identifier"), F.when(k % 3 > 0, F.array(F.lit("EN 1"))).otherwise(F.array(F.lit("EN 2"))).alias("supplied"), F.when(k % 4 > 0, "AMENDED").otherwise("READ").alias("action"))
    whole = segments.spans_of(docs.withColumnRenamed("doc_id", "candidate_id"), "candidate_id", F.col("text"), lambda t: [(0, len(t))] if t else [])
    cites = docs.select(k.alias("candidate_id"), F.when(k % 2 == 0, F.array(F.lit("S1"))).otherwise(F.array(F.lit("S2"))).alias("ids"))
    return review.monitored_change(rows, segments.cited(cites, whole, "candidate_id")).select("candidate_id", "violation")


_OBSERVED = "SELECT l_orderkey AS candidate_id, 'f' || CAST(l_linenumber % 3 AS STRING) AS field, l_partkey * 10 + l_linenumber AS position, CASE WHEN l_quantity > 10 THEN l_returnflag END AS value, CASE WHEN l_quantity > 48 THEN 'QUOTE_' || l_linestatus END AS failure FROM {lineitem}"


@query(f"""
WITH o AS ({duck(_OBSERVED)}), g AS (SELECT candidate_id, field, min(CASE WHEN failure IS NOT NULL THEN {{'position': position, 'failure': failure}} END).failure AS failed, count(DISTINCT value) AS n, min(value) AS v FROM o GROUP BY 1, 2)
SELECT candidate_id, field, CASE WHEN failed IS NULL AND n = 1 THEN v END AS value, coalesce(failed, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 0 THEN 'NOT_STATED' ELSE 'NONE' END) AS diagnostic FROM g""")
def metadata_fields(spark, d):
    return review.metadata(given(spark, d, _OBSERVED))


@query(f"""
WITH j AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_linenumber % 4 AS r, l_partkey % 3 AS a, l_suppkey % 3 AS b, l_discount * 12 AS c FROM lineitem)
SELECT k, {_first(("RELATION", "r < 3"), ("SUPPORT", "r > 0 OR (a > 0 AND b > 0)"), ("CONFIDENCE", "c BETWEEN 0 AND 1"))} AS violation FROM j""")
def pair_judgements(spark, d):
    spans = lambda c: F.when(c > 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>"))
    relation = F.element_at(F.array(*[F.lit(x) for x in ("SAME_EVENT", "DISTINCT_EVENT", "UNCERTAIN", "ODD")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), relation.alias("relation"), spans(F.col("l_partkey") % 3).alias("left_spans"), spans(F.col("l_suppkey") % 3).alias("right_spans"), (F.col("l_discount") * 12).alias("confidence"))
    return review.judgement(rows).select("k", "violation")


_WRITTEN = "SELECT CAST(o_orderkey AS STRING) AS event_id, o_orderkey % 9 AS canonical_id, 'u' || CAST(o_orderkey % 4 AS STRING) AS url, CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE 'h' END AS headline, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'p' END AS prose FROM {orders}"
_WMEMBERS = "SELECT CAST(o_orderkey AS STRING) AS event_id, o_orderkey % 9 - CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS candidate_id, 'u' || CAST(o_orderkey % 3 AS STRING) AS url, o_orderkey % 5 > 0 AS canonical FROM {orders}"


@query(f"""
WITH w AS ({duck(_WRITTEN)}), m AS ({duck(_WMEMBERS)}), s AS (SELECT event_id, count(*) AS n, min(candidate_id) AS c, min(url) AS u FROM m WHERE canonical GROUP BY 1)
SELECT event_id, {_first(("EVENT_ID", "event_id <> ''"), ("HEADLINE", "trim(headline) <> ''"), ("PROSE", "trim(prose) <> ''"), ("CANONICAL", "n = 1"), ("CANONICAL_ID", "canonical_id = c"), ("URL", "url = u"))} AS violation FROM w LEFT JOIN s USING (event_id)""")
def event_boundaries(spark, d):
    return review.boundaries(given(spark, d, _WRITTEN), given(spark, d, _WMEMBERS)).select("event_id", "violation")


_ASSESSED = "SELECT l_orderkey AS event_id, 'u' || CAST(l_linenumber AS STRING) AS unit_id, CASE WHEN l_quantity > 25 THEN 'r' || CAST(l_suppkey % 4 AS STRING) END AS reference FROM {lineitem}"
_UNITS = "SELECT l_orderkey AS event_id, 'u' || CAST(CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS STRING) AS unit_id FROM {lineitem} WHERE l_linenumber < 5 OR l_orderkey % 3 > 0"
_REFERENCES = "SELECT l_orderkey AS event_id, 'r' || CAST(l_suppkey % 4 AS STRING) AS reference FROM {lineitem} WHERE l_suppkey % 4 > 0"
_HAS, _KNOWN = (x.replace("SELECT", "SELECT DISTINCT", 1) for x in (_UNITS, _REFERENCES))


@query(f"""
WITH a AS ({duck(_ASSESSED)}), u AS ({duck(_HAS)}), k AS ({duck(_KNOWN)}), c AS (SELECT event_id, unit_id, count(*) AS times FROM a GROUP BY 1, 2),
s AS (SELECT coalesce(u.event_id, c.event_id) AS event_id, bool_or(times IS NULL) AS missing, bool_or(u.unit_id IS NULL) AS extra, bool_or(coalesce(times > 1, false)) AS twice FROM u FULL JOIN c ON u.event_id = c.event_id AND u.unit_id = c.unit_id GROUP BY 1),
b AS (SELECT DISTINCT event_id FROM a WHERE reference IS NOT NULL AND (event_id, reference) NOT IN (SELECT (event_id, reference) FROM k))
SELECT s.event_id AS event_id, CASE WHEN missing THEN 'MISSING_UNIT' WHEN extra THEN 'EXTRA_UNIT' WHEN twice THEN 'REPEATED_UNIT' WHEN b.event_id IS NOT NULL THEN 'CITATION' END AS violation FROM s LEFT JOIN b USING (event_id)""")
def assessment_structure(spark, d):
    n = 4 * table(spark, d, "lineitem").count()  # each line is assessed, cited, and may be a unit and a reference
    return review.structure(given(spark, d, _ASSESSED), given(spark, d, _UNITS), given(spark, d, _REFERENCES), n)


@query("""
SELECT l_orderkey, l_linenumber, field, assessment FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'insight' ELSE 'summary' END AS field, ['SUPPORTED', 'NEUTRAL', 'ANALYSIS', 'UNSUPPORTED', NULL][l_partkey % 5 + 1] AS assessment FROM lineitem)
WHERE NOT coalesce(assessment IN ('SUPPORTED', 'NEUTRAL') OR (field = 'insight' AND assessment = 'ANALYSIS'), false)""")
def disallowed_assessments(spark, d):
    assessment = F.element_at(F.array(*[F.lit(x) for x in ("SUPPORTED", "NEUTRAL", "ANALYSIS", "UNSUPPORTED", None)]), (F.col("l_partkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "insight").otherwise("summary").alias("field"), assessment.alias("assessment"))
    return review.assessed_fields(rows)


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS message, min(l_partkey * 10 + l_linenumber) AS at_ FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(message, chr(10) ORDER BY at_, message) AS feedback FROM f GROUP BY 1""")
def correction_feedback(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"), F.concat("l_returnflag", "l_linestatus").alias("message"))
    return review.corrections(rows, "l_orderkey", "k", "message")


_SYSTEMS = "['ROLLING_STOCK', 'SIGNALLING', 'POWER_SUPPLY', 'COMMUNICATIONS', 'AUTOMATIC_FARE_COLLECTION', 'DEPOT_MAINTENANCE_EQUIPMENT', 'PLATFORM_SCREEN_DOORS']"


@query(f"""
WITH s AS (SELECT l_orderkey, list({_SYSTEMS}[l_linenumber % 7 + 1]) AS xs FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(list_distinct(xs)) = len(xs) THEN array_to_string(list_filter({_SYSTEMS}, lambda x: list_contains(xs, x)), ',') END AS systems FROM s""")
def system_order(spark, d):
    system = F.element_at(F.array(*[F.lit(s) for s in review.SYSTEMS]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(system).alias("xs"))
    return rows.select("l_orderkey", F.array_join(review.canonical_systems(F.col("xs")), ",").alias("systems"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_linenumber % 7 + 1 AS p, l_partkey AS c, l_suppkey AS a, l_suppkey + l_linenumber AS b FROM lineitem) SELECT l_orderkey, string_agg(p || ':' || c || ':' || a || '-' || b, ' ' ORDER BY p, c, a, b) AS spans FROM s GROUP BY 1""")
def span_order(spark, d):
    system = F.element_at(F.array(*[F.lit(s) for s in review.SYSTEMS]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", system.alias("system"), F.col("l_partkey").alias("candidate_id"), F.col("l_suppkey").alias("start"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("end"))
    shown = F.transform("spans", lambda s: F.concat(s["place"], F.lit(":"), s["candidate_id"], F.lit(":"), s["start"], F.lit("-"), s["end"]))
    return review.ordered_spans(rows, "l_orderkey").select("l_orderkey", F.array_join(shown, " ").alias("spans"))


_MONITORED = "SELECT l_orderkey AS event_id, l_partkey AS candidate_id, CASE WHEN l_orderkey % 3 = 0 OR (l_orderkey % 3 = 1 AND l_linenumber > 1) THEN 'EN ' || CAST(l_partkey AS STRING) END AS standard, CASE WHEN l_orderkey % 2 = 0 THEN 'NORMATIVE_CHANGE' ELSE 'INCIDENT' END AS category, l_linenumber = 2 AS canonical, l_partkey * 10 + l_linenumber AS list_order FROM {lineitem}"


@query(f"""
WITH m AS ({duck(_MONITORED)}), s AS (SELECT event_id, bool_or(standard IS NOT NULL) AS has_one, bool_and(standard IS NOT NULL) AS every, min(category) AS c FROM m GROUP BY 1)
SELECT event_id, CASE WHEN has_one <> every THEN 'MIXED' WHEN has_one AND c <> 'NORMATIVE_CHANGE' THEN 'CATEGORY' END AS violation FROM s""")
def monitored_restriction(spark, d):
    return review.restricted(given(spark, d, _MONITORED))


@query(f"""
WITH m AS ({duck(_MONITORED)}) SELECT event_id, coalesce(max(CASE WHEN canonical THEN standard END), arg_min(standard, list_order) FILTER (standard IS NOT NULL)) AS standard FROM m GROUP BY 1""")
def event_standard(spark, d):
    return review.standard_of(given(spark, d, _MONITORED))


@query("""
WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'EVIDENCE' WHEN o_totalprice > 300000 THEN 'SCOPE' WHEN o_orderkey % 4 = 0 THEN 'CATEGORY' ELSE 'NONE' END AS failure FROM orders) SELECT failure, count(*) AS n FROM r GROUP BY 1""")
def evaluation_summary(spark, d):
    failure = review.earliest_failure({"EVIDENCE": F.col("o_orderstatus") != "P", "SCOPE": F.col("o_totalprice") <= 300000, "CATEGORY": F.col("o_orderkey") % 4 != 0})
    return review.evaluation(table(spark, d, "orders").withColumn("failure", failure), "failure")


@query("""
SELECT user_id, count(DISTINCT event_id % 3) AS rounds, count(DISTINCT event_type) AS outcomes, count(DISTINCT event_id % 3) = 3 AND count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY 1""")
def round_stability(spark, d):
    rows = table(spark, d, "events").withColumn("round", F.col("event_id") % 3)
    return review.stable(rows, "user_id", "round", "event_type", 3)


@query("""
SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 3 = 0 AND text <> 'x' THEN 'MISMATCH' ELSE 'MATCH' END AS digest FROM documents""")
def digest_states(spark, d):
    k = F.col("doc_id")
    recorded = F.when(k % 5 != 0, F.when(k % 3 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256)))
    return table(spark, d, "documents").select("doc_id", review.digest_state(recorded, F.col("text")).alias("digest"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS a, o_orderkey % 4 > 0 AS b, o_orderkey % 5 = 0 AS low FROM orders) SELECT o_orderkey, CASE WHEN a AND b THEN CASE WHEN low THEN 'NOT_REPORTABLE' ELSE 'REPORTABLE' END ELSE 'NOT_REACHED' END AS gate FROM r""")
def workflow_gate(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.when(k % 3 > 0, "ASSIGNED").otherwise("UNRESOLVED").alias("category_state"), F.when(k % 4 > 0, "EVALUATED").alias("taxonomy_state"), F.when(k % 5 == 0, "AWARD_OR_RANKING").otherwise("OPENING").alias("occurrence"), F.lit("REPORTABLE").alias("proposed"))
    return review.reportable(rows).select("o_orderkey", "gate")


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^[A-Za-z0-9_.:/-]{1,96}$') THEN p_type ELSE 'UNKNOWN' END AS token, replace(replace('<' || p_name || '> & ' || p_brand, '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') AS html, '\\[' || p_name || '\\]' AS link FROM part""")
def safe_texts(spark, d):
    html = text.escape_html(F.concat(F.lit("<"), "p_name", F.lit("> & "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", text.safe_token(F.col("p_type")).alias("token"), html.alias("html"), text.escape_link(F.concat(F.lit("["), "p_name", F.lit("]"))).alias("link"))
