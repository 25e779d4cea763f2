"""Queries of smaller operators: AMP pages, citations, facts, plan order, subjects, lists of places, key checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import constraints, discovery, evidence, review
from ..sources.tables import table
from ._register import duck, given, query

_AMP = """SELECT page_id, 'https://www.h' || CAST(page_id % 5 AS STRING) || '.example/a/b/c' || CAST(page_id AS STRING) AS url,
  CASE WHEN page_id % 7 = 0 THEN '<html lang="x">' WHEN page_id % 7 = 1 THEN '<html lang="x" ⚡>' ELSE '<HTML amp lang="x">' END || '<head><link rel="canonical" href="'
  || CASE page_id % 6 WHEN 0 THEN '/x/' || CAST(page_id AS STRING) WHEN 1 THEN '../y?utm_source=1&q=2' WHEN 2 THEN 'https://other.example/z' WHEN 3 THEN 'https://h' || CAST(page_id % 5 AS STRING) || '.example/w' WHEN 4 THEN 'c' || CAST(page_id AS STRING) ELSE '//www.h' || CAST(page_id % 5 AS STRING) || '.example/v' END || '">'
  || CASE WHEN page_id % 11 = 0 THEN '<link href="/x" rel=canonical>' ELSE '' END || '</head>' AS html FROM {pages}"""


@query(f"""
WITH a AS ({duck(_AMP)})
SELECT page_id, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN '' ELSE CASE page_id % 6 WHEN 0 THEN 'https://www.h' || page_id % 5 || '.example/x/' || page_id WHEN 1 THEN 'https://www.h' || page_id % 5 || '.example/a/y?q=2'
  WHEN 3 THEN 'https://h' || page_id % 5 || '.example/w' WHEN 5 THEN 'https://www.h' || page_id % 5 || '.example/v' ELSE '' END END AS canonical FROM a""")
def amp_canonicals(spark, d):
    """Articles that AMP pages declare: from the root, beside the page, on another host, themselves, or twice."""
    return given(spark, d, _AMP).select("page_id", urls.amp_canonical(F.col("html"), F.col("url")).alias("canonical"))


_CITED = "SELECT l_orderkey AS subject_id, l_linenumber * 100000 + l_partkey AS ordinal, 'S' || CAST(l_linenumber % 3 AS STRING) AS source_ref, 'S' || CAST(l_suppkey % 5 AS STRING) AS sentence_id FROM {lineitem}"
_REFS = "SELECT o_orderkey AS subject_id, 'S' || CAST(k AS STRING) AS source_ref, o_custkey * 10 + k AS candidate_id FROM {orders} CROSS JOIN (VALUES (0), (1), (2)) AS v(k) WHERE k < 2 OR o_orderkey % 10 > 0"
_TOLD = "SELECT c_custkey * 10 + k % 3 AS candidate_id, 'S' || CAST(k % 5 AS STRING) AS sentence_id, CAST(k % 5 * 10 AS INT) AS start_at, CAST(k % 5 * 10 + 9 AS INT) AS end_at FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14)) AS v(k) WHERE c_custkey % 4 > 0 OR k % 5 < 4"


@query(f"""
WITH c AS ({duck(_CITED)}), r AS ({duck(_REFS)}), s AS ({duck(_TOLD)}),
m AS (SELECT c.*, r.candidate_id, s.start_at, s.end_at, CASE WHEN r.candidate_id IS NULL THEN 'UNKNOWN_SOURCE' WHEN s.start_at IS NULL THEN 'UNRESOLVED_SENTENCE' END AS fault
  FROM c LEFT JOIN r ON r.subject_id = c.subject_id AND r.source_ref = c.source_ref LEFT JOIN s ON s.candidate_id = r.candidate_id AND s.sentence_id = c.sentence_id),
o AS (SELECT subject_id, candidate_id, start_at, end_at, min(ordinal) AS first FROM m GROUP BY ALL)
SELECT subject_id, f.fault IS NULL AS valid, f.fault AS reason, CASE WHEN f.fault IS NULL THEN spans END AS spans
FROM (SELECT subject_id, arg_min(fault, ordinal) FILTER (fault IS NOT NULL) AS fault FROM m GROUP BY 1) f
JOIN (SELECT subject_id, string_agg(candidate_id || ':' || start_at || '-' || end_at, ',' ORDER BY first, candidate_id, start_at) AS spans FROM o GROUP BY 1) USING (subject_id)""")
def citation_spans(spark, d):
    """Citations of orders by short references of their sources; some sources and sentences don't exist."""
    sentences = given(spark, d, _TOLD).withColumnsRenamed({"start_at": "start", "end_at": "end"})
    found = review.citation_spans(given(spark, d, _CITED), given(spark, d, _REFS), sentences)
    shown = F.array_join(F.transform("spans", lambda s: F.concat(s["candidate_id"], F.lit(":"), s["start"], F.lit("-"), s["end"])), ",")
    return found.withColumn("spans", shown)


@query("""
SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 2 = 0 THEN 'action=' || p_type END, CASE WHEN p_size % 3 > 0 THEN 'asset=' || p_brand END, CASE WHEN p_size % 5 = 0 THEN 'source_claims={"a":"' || p_size || '","b":"' || p_brand || '"}' END) AS facts FROM part""")
def stated_facts(spark, d):
    """Facts of parts without the blank ones, with their claims by key."""
    p = table(spark, d, "part")
    claims = F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("b"), F.col("p_brand"), F.lit("a"), F.col("p_size").cast("string")))
    facts = text.stated_facts(claims, action=F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), asset=F.when(F.col("p_size") % 3 > 0, F.col("p_brand")), subject=F.lit(""))
    return p.select("p_partkey", F.array_join(F.transform(F.map_entries(facts), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("facts"))


_PLAN = """SELECT p_partkey AS id, p_size % 4 AS intent_place, CASE WHEN p_size % 7 > 0 THEN p_brand END AS market, p_type AS profile, p_name AS family, 'p' || CAST(p_partkey % 2 AS STRING) AS provider, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS language,
  '' AS anchor, CAST(p_partkey % 9 AS STRING) AS term, CAST(p_partkey AS STRING) AS query, CASE p_size % 4 WHEN 3 THEN 'MONITORED_STANDARDS' ELSE 'I' || CAST(p_size % 4 AS STRING) END AS intent FROM {part}"""


@query(f"WITH p AS ({duck(_PLAN)}) SELECT id, row_number() OVER (ORDER BY intent_place, market NULLS FIRST, profile, family, provider, language, anchor, term, query) AS position FROM p")
def canonical_plan_order(spark, d):
    """Plan items numbered by all nine keys."""
    return discovery.canonical_order(given(spark, d, _PLAN)).select("id", "position")


@query(f"WITH p AS ({duck(_PLAN)}) SELECT id, intent FROM p WHERE intent <> 'MONITORED_STANDARDS' OR id % 2 = 0")
def intents_due(spark, d):
    return discovery.intents_due(given(spark, d, _PLAN), F.when(F.col("id") % 3 >= 0, F.col("id") % 2 == 0)).select("id", "intent")


@query("""
SELECT o_orderkey, 'Weekly｜' || CASE WHEN o_orderkey % 5 = 0 THEN 'R' || o_orderkey ELSE strftime(o_orderdate, '%Y/%m/%d') || ' - ' || CASE WHEN year(o_orderdate + INTERVAL 6 DAYS) = year(o_orderdate) THEN strftime(o_orderdate + INTERVAL 6 DAYS, '%m/%d') ELSE strftime(o_orderdate + INTERVAL 6 DAYS, '%Y/%m/%d') END END || '｜' || o_custkey || ' 則' AS subject,
  'developer_debug_weekly_' || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS debug, 'engineering_summary_weekly_' || strftime(o_orderdate, '%Y-%m-%d') || '.json' AS summary FROM orders""")
def subjects_and_files(spark, d):
    day = F.col("o_orderdate").cast("date")
    period = F.when(F.col("o_orderkey") % 5 > 0, text.period_display(day, F.date_add(day, 6)))
    files = text.file_names("weekly", day)
    return table(spark, d, "orders").select("o_orderkey", text.subject("Weekly", period, F.concat(F.lit("R"), "o_orderkey"), F.col("o_custkey")).alias("subject"), files["developer_debug"].alias("debug"), files["engineering_summary"].alias("summary"))


_PLACES = """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'City, Region and  Area' WHEN 1 THEN s_name || '、City' WHEN 2 THEN '' ELSE 'city & ' || s_name || '與區' END AS listed, '서울' || CASE WHEN s_suppkey % 2 = 0 THEN '市 ' ELSE ' 市' END || '역' AS mixed FROM {supplier}"""


@query(f"""
WITH p AS ({duck(_PLACES)}) SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'City|Region|Area' WHEN 1 THEN s_name || '|City' WHEN 2 THEN '' ELSE 'city|' || s_name || '|區' END AS places, s_suppkey % 4 = 0 AS generic, CASE WHEN s_suppkey % 2 = 0 THEN '서울市' ELSE '市역' END AS mixed FROM p JOIN supplier USING (s_suppkey)""")
def places_and_scripts(spark, d):
    """Lists of places, whether they name nothing but general terms, and words in two scripts."""
    listed = text.places_listed(F.col("listed"))
    general = F.array(*[F.lit(x) for x in ("city", "region", "area")])
    return given(spark, d, _PLACES).select("s_suppkey", F.array_join(listed, "|").alias("places"), text.all_generic(listed, general).alias("generic"), F.array_join(text.mixed_script_words(F.col("mixed")), "|").alias("mixed"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) ELSE '' END || p_type AS said, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE '|' || p_type END AS lead FROM part""")
def catalogue_texts(spark, d):
    """Catalogue records as text without blank fields, and their first two sentences."""
    first = F.when(F.col("p_size") % 3 == 0, F.array("p_name")).otherwise(F.array("p_name", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", evidence.catalogue_text(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("  "), F.lit(None).cast("string"), F.col("p_type")).alias("said"), F.array_join(text.highlights(first), "|").alias("lead"))


@query("""
SELECT l_orderkey AS key, 'REPEATED' AS fault, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'NO_PARENT', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 0) GROUP BY 1""")
def key_faults(spark, d):
    """Keys that repeat, and those without a parent."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    parents = table(spark, d, "orders").where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("key"))
    return constraints.key_faults(items, parents, "key")


@query("""
WITH g AS (SELECT DISTINCT o_orderkey AS event_id, o_orderstatus FROM orders WHERE o_orderkey % 7 > 0), m AS (SELECT l_orderkey AS event_id, count(*) AS members FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS event_id, o_orderpriority FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey, 'twice' FROM orders WHERE o_orderkey % 50 = 1),
k AS (SELECT event_id, count(DISTINCT side) AS sides, count(*) AS n FROM (SELECT event_id, 1 AS side FROM g UNION ALL SELECT event_id, 2 FROM m UNION ALL SELECT event_id, 3 FROM c) GROUP BY 1)
SELECT event_id, CASE WHEN sides < 3 THEN 'MISSING' WHEN n > 3 THEN 'REPEATED' END AS fault, CASE WHEN sides = 3 AND n = 3 THEN o_orderstatus END AS o_orderstatus, CASE WHEN sides = 3 AND n = 3 THEN members END AS members,
  CASE WHEN sides = 3 AND n = 3 THEN o_orderpriority END AS o_orderpriority FROM k LEFT JOIN g USING (event_id) LEFT JOIN m USING (event_id) LEFT JOIN (SELECT event_id, min(o_orderpriority) AS o_orderpriority FROM c GROUP BY 1) USING (event_id)""")
def aligned_results(spark, d):
    """Groups, members and categories of events matched by key; what one of them lacks or has twice is named."""
    o, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    event = F.col("o_orderkey").alias("event_id")
    groups = o.where("o_orderkey % 7 > 0").select(event, "o_orderstatus")
    categories = o.where("o_orderkey % 5 > 0").select(event, "o_orderpriority").unionByName(o.where("o_orderkey % 50 = 1").select(event, F.lit("twice").alias("o_orderpriority")))
    return review.aligned(groups, items.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.count(F.lit(1)).alias("members")), categories)
