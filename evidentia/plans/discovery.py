"""Queries over plans, requests, acquisitions, candidates, evidence gates and regions.

Nations are markets, regions their profiles, brands the query families; orders are attempts, and their line items the results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import discovery, evidence, places
from ..sources.tables import table
from ._register import duck, given, query

_MARKETS = "SELECT n_name AS market, r_name AS profile FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_BINDINGS = "SELECT r_name AS profile, 'p' || CAST(r_regionkey % 2 AS STRING) AS provider, CASE WHEN r_regionkey = 2 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS support FROM {region} WHERE r_regionkey <> 4"
_FAMILIES = "SELECT DISTINCT p_brand AS family, CASE WHEN p_brand LIKE '%1' THEN 'NORMATIVE' ELSE 'NEWS' END AS intent FROM {part}"


def _families(spark, d):
    some = table(spark, d, "nation").where("n_nationkey % 3 = 0").agg(F.array_sort(F.collect_set("n_name")).alias("some"))
    rows = given(spark, d, _FAMILIES).crossJoin(F.broadcast(some))
    return rows.select("family", "intent", F.when(F.col("family").endswith("3"), F.col("some")).otherwise(F.array().cast("array<string>")).alias("markets"))


_ITEMS = f"""
mk AS ({duck(_MARKETS)}), bd AS ({duck(_BINDINGS)}), fm AS ({duck(_FAMILIES)}),
it AS (SELECT market, profile, family, intent, provider FROM mk JOIN bd USING (profile), fm WHERE support <> 'UNSUPPORTED' AND (family NOT LIKE '%3' OR market IN (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0)))"""


@query(f"WITH {_ITEMS} SELECT * FROM it")
def plan_items(spark, d):
    """Markets times families: families that list no market take all, unsupported bindings drop out."""
    return discovery.plan_items(given(spark, d, _MARKETS), _families(spark, d), given(spark, d, _BINDINGS))


@query(f"WITH mk AS ({duck(_MARKETS)}), bd AS ({duck(_BINDINGS)}) SELECT market FROM mk WHERE profile NOT IN (SELECT profile FROM bd)")
def unbound_markets(spark, d):
    return discovery.unbound(given(spark, d, _MARKETS), given(spark, d, _BINDINGS))


@query(f"WITH {_ITEMS} SELECT DISTINCT market FROM mk WHERE market NOT IN (SELECT market FROM it)")
def markets_without_items(spark, d):
    return discovery.without_items(given(spark, d, _MARKETS), plan_items(spark, d), "market")


@query(f"""
WITH {_ITEMS}, t AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size = 1), a AS (SELECT unnest(['line', 'depot works']) AS anchor), k AS (SELECT p_brand, count(*) AS n FROM t GROUP BY 1)
SELECT market, family, anchor, p_type AS term, market || ' ' || anchor || ' "' || p_type || '"' AS query, n * 2 <= 5 AS fits FROM it JOIN t ON p_brand = family JOIN k USING (p_brand), a""")
def concrete_requests(spark, d):
    """A request for each anchor and term of an item; term lists that give more than five are marked."""
    terms = table(spark, d, "part").where("p_size = 1").groupBy(F.col("p_brand").alias("family")).agg(F.collect_set("p_type").alias("terms"))
    items = plan_items(spark, d).join(terms, "family")
    return discovery.concrete_requests(items, ['{market}  {anchor} "{term}"'], ("line", "depot works"), F.col("terms"), 5).select("market", "family", "anchor", "term", "query", "fits")


@query("""
SELECT p_partkey, word_count - 2 AS words, '(' || CASE WHEN contains(p_name, ' ') THEN '"' || p_name || '"' ELSE 'title:' || p_name END || ' OR ' || CASE WHEN contains(p_type, ' ') THEN '"' || p_type || '"' ELSE 'title:' || p_type END || ')' AS query
FROM (SELECT *, len(string_split_regex(trim(p_name), '\\s+')) + len(string_split_regex(trim(p_type), '\\s+')) + 3 AS word_count FROM part)""")
def or_groups(spark, d):
    group = text.or_group(F.array("p_name", "p_type"), "title:")
    return table(spark, d, "part").select("p_partkey", text.word_count(group).cast("long").alias("words"), group.alias("query"))


@query("""
WITH RECURSIVE t AS (SELECT p_brand, p_name AS term, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k, len(string_split_regex(trim(p_name), '\\s+')) AS w FROM (SELECT DISTINCT p_brand, p_name FROM part)),
s AS (SELECT p_brand, k, 1 AS grp, w AS used FROM t WHERE k = 1
  UNION ALL SELECT t.p_brand, t.k, CASE WHEN used + 1 + w <= 12 THEN grp ELSE grp + 1 END, CASE WHEN used + 1 + w <= 12 THEN used + 1 + w ELSE w END FROM s JOIN t ON s.p_brand = t.p_brand AND t.k = s.k + 1)
SELECT p_brand, grp, string_agg(term, '|' ORDER BY k) AS terms FROM s JOIN t USING (p_brand, k) GROUP BY 1, 2""")
def term_packing(spark, d):
    """Names of each brand's parts in groups of at most twelve words and ORs."""
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("terms"))
    groups = rows.select("p_brand", F.posexplode(text.packed_terms(F.col("terms"), 12)).alias("n", "g"))
    return groups.select("p_brand", (F.col("n") + 1).alias("grp"), F.array_join("g", "|").alias("terms"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_custkey, o_orderstatus FROM orders)
SELECT o_custkey, position, position <= coalesce((SELECT min(position) FROM o WHERE o_orderstatus = 'P' AND position > 3), 1000000) AS executed FROM o""")
def plan_execution(spark, d):
    """Items up to the first failure (here a P order after the third item) are executed, those after it aren't attempted."""
    from pyspark.sql import Window

    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"))
    return discovery.executed(rows, "position", (F.col("o_orderstatus") == "P") & (F.col("position") > 3)).select("o_custkey", "position", "executed")


@query("""
SELECT o_orderkey, 'https://feed.example/search?q=' || o_custkey || '+after%3A' || strftime(o_orderdate, '%Y-%m-%d') || '+before%3A' || strftime(o_orderdate::DATE + 7, '%Y-%m-%d') AS url FROM orders""")
def request_urls(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", discovery.request_url("https://feed.example/search", F.col("o_custkey").cast("string"), day, F.date_add(day, 6)).alias("url"))


def _attempts(spark, d):
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_extendedprice"))).alias("results"))
    status = F.when(F.col("o_orderstatus") == "P", "FAILED").when(F.col("results").isNull(), "ZERO_RESULTS").otherwise("SUCCESS_WITH_RESULTS")
    rows = table(spark, d, "orders").where("o_orderkey % 10 <> 9").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("plan_item_id"), status.alias("status"), "results")


def _plan(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_item_id"), F.col("o_orderpriority").alias("intent"), F.col("o_custkey").alias("position"))


_ATTEMPTS = """
att AS (SELECT o_orderkey AS plan_item_id, o_orderpriority AS intent, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' WHEN count(l_orderkey) = 0 THEN 'ZERO_RESULTS' ELSE 'SUCCESS_WITH_RESULTS' END AS status, count(l_orderkey) AS results
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 10 <> 9 GROUP BY o_orderkey, o_orderpriority, o_orderstatus)"""


@query(f"""
WITH {_ATTEMPTS} SELECT plan_item_id, intent, row_number() OVER (PARTITION BY plan_item_id ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS ordinal, l_partkey, l_suppkey, l_extendedprice
FROM att JOIN lineitem ON l_orderkey = plan_item_id WHERE status = 'SUCCESS_WITH_RESULTS'""")
def acquisitions(spark, d):
    return discovery.acquisitions(_attempts(spark, d), _plan(spark, d))


_OBSERVED = f"""{_ATTEMPTS}, ob AS (
  SELECT o_orderkey AS plan_item_id, coalesce(status, 'NOT_ATTEMPTED') AS status, CASE WHEN status IS NULL THEN 0 ELSE results END AS results,
    CASE WHEN status = 'SUCCESS_WITH_RESULTS' THEN (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) ELSE 0 END AS candidates FROM orders LEFT JOIN att ON plan_item_id = o_orderkey)"""


@query(f"WITH {_OBSERVED} SELECT * FROM ob")
def plan_observations(spark, d):
    """What each plan item came to, with the distinct candidates (parts) that its results named."""
    attempts = _attempts(spark, d)
    origins = discovery.acquisitions(attempts, _plan(spark, d)).select("plan_item_id", F.col("l_partkey").alias("candidate_id"))
    return discovery.observations(_plan(spark, d), attempts, origins)


@query(f"""
WITH {_OBSERVED}, c AS (SELECT count(*) FILTER (status <> 'NOT_ATTEMPTED') AS attempted, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'NOT_ATTEMPTED') AS missed FROM ob)
SELECT *, CASE WHEN attempted = failed THEN 'BLOCK' WHEN failed + missed > 0 THEN 'PASS_WITH_GAPS' ELSE 'LEGAL' END AS acceptance FROM c""")
def search_acceptance(spark, d):
    return discovery.acceptance(plan_observations(spark, d))


@query(f"""
WITH {_ATTEMPTS} SELECT o_custkey AS position, plan_item_id, CASE WHEN c_acctbal < 0 THEN 'RATE_LIMIT' WHEN c_acctbal < 5000 THEN 'INVALID' ELSE 'UNKNOWN' END AS failure, CASE WHEN c_acctbal < 0 THEN 429 WHEN c_acctbal < 5000 THEN 500 END AS status_code
FROM att JOIN orders ON o_orderkey = plan_item_id JOIN customer ON c_custkey = o_custkey WHERE status = 'FAILED'""")
def attempt_failures(spark, d):
    known = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_acctbal < 5000")
    known = known.select(F.col("o_orderkey").alias("plan_item_id"), F.when(F.col("c_acctbal") < 0, "RATE_LIMIT").otherwise("INVALID").alias("failure"), F.when(F.col("c_acctbal") < 0, 429).otherwise(500).alias("status_code"))
    return discovery.attempt_failures(_plan(spark, d), _attempts(spark, d), known)


@query("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'Superseding' ELSE 'Active' END AS status FROM orders)
SELECT o_orderkey FROM e WHERE CASE WHEN day IS NULL THEN status = 'Superseding' ELSE day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' END""")
def catalogue_window(spark, d):
    entries = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderdate").cast("date")).alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "Superseding").otherwise("Active").alias("status"))
    return discovery.catalogue_entries_in(entries, F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date")).select("o_orderkey")


_FOUND = """SELECT event_id AS acquisition_id, CASE WHEN event_id % 11 = 0 THEN 'ftp://h/x' WHEN event_id % 13 = 0 THEN 'http://h /x' ELSE 'https://h' || CAST(user_id AS STRING) || '.example/' || event_type END AS url,
  'T' || CAST(event_id % 3 AS STRING) AS title, 'P' || CAST(event_id % 2 AS STRING) AS publisher, CAST(CAST(ts AS DATE) AS STRING) AS published_at, CAST(event_id AS STRING) AS snippet, 'I' || CAST(event_id % 4 AS STRING) AS intent FROM {events}"""


@query(f"""
WITH f AS ({duck(_FOUND)}), g AS (SELECT url, min({{'title': title, 'publisher': publisher, 'published_at': published_at, 'snippet': snippet}}) AS r, min(intent) AS intent, string_agg(acquisition_id, ',' ORDER BY acquisition_id) AS origins
  FROM f WHERE acquisition_id % 11 <> 0 AND acquisition_id % 13 <> 0 GROUP BY url)
SELECT 'cand_' || sha256('{{"url":"' || url || '"}}') AS candidate_id, url, r.title AS title, r.publisher AS publisher, r.published_at AS published_at, r.snippet AS snippet, intent, origins FROM g""")
def normalised_candidates(spark, d):
    """One candidate for each exact url, from url checks to origins."""
    return discovery.normalised(given(spark, d, _FOUND)).withColumn("origins", F.array_join("origins", ","))


@query("""
SELECT source, n_chars FROM documents GROUP BY ALL HAVING count(DISTINCT sha256(text)) > 1""")
def conflicting_occurrences(spark, d):
    return discovery.conflicting_occurrences(table(spark, d, "documents"), ("source", "n_chars"), F.sha2("text", 256))


_PAGES = """SELECT page_id, 'https://a.example/' || CAST(page_id AS STRING) AS url, CASE page_id % 9 WHEN 1 THEN 'https://a.example/b c' ELSE 'https://www.b.example/' || CAST(page_id AS STRING) END AS resolved_url, page_id % 9 <> 2 AS fetched,
  CASE page_id % 9 WHEN 3 THEN 404 ELSE 200 END AS status_code, CASE page_id % 9 WHEN 4 THEN 'image/png' ELSE 'Text/HTML; charset=utf-8' END AS content_type, CASE page_id % 9 WHEN 6 THEN 'COLLECTION' ELSE 'READY' END AS document_status,
  CASE page_id % 9 WHEN 5 THEN 'https://c.example/' WHEN 7 THEN 'https://a.example/' || CAST(page_id AS STRING) ELSE 'https://a.example/' || CAST(page_id AS STRING) END AS first_hop,
  CASE page_id % 9 WHEN 7 THEN ' ' WHEN 8 THEN ' A  TITLE ' ELSE 'A title and more' END AS body, 'a title' AS title FROM {pages}"""
_GATES = ("", "LINK_RESOLUTION", "FETCH_TRANSPORT", "HTTP_STATUS", "CONTENT_TYPE", "SOURCE_PROVENANCE", "PRINCIPAL_DOCUMENT", "BODY_AVAILABILITY", "FACTUAL_SUBSTANCE")


def _hops(spark, d):
    rows = given(spark, d, _PAGES)
    return rows.withColumn("chain", F.array("first_hop", F.when(F.col("page_id") % 9 == 1, F.lit("https://www.b.example/")).otherwise(F.col("resolved_url")))).withColumn("headlines", F.array("title"))


@query(f"""
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'READY' ELSE 'REJECTED' END AS state, nullif(['{"', '".join(_GATES)}'][page_id % 9 + 1], '') AS gate,
  [NULL, 'URL_UNRESOLVED', 'CONTENT_UNAVAILABLE', 'CONTENT_UNAVAILABLE', 'CONTENT_UNAVAILABLE', 'SOURCE_PAGE_MISMATCH', 'INSUFFICIENT_SUBSTANCE', 'INSUFFICIENT_SUBSTANCE', 'TITLE_ONLY'][page_id % 9 + 1] AS reason FROM pages""")
def evidence_gates(spark, d):
    """The first gate that a source fails, and the reason it stands for."""
    return evidence.judged(_hops(spark, d)).select("page_id", "state", "gate", "reason")


@query("""
SELECT page_id, CASE page_id % 9 WHEN 1 THEN 'REDIRECTED' ELSE 'REDIRECTED' END AS path, 2 AS hops, page_id % 9 = 5 AS start_differs,
  page_id % 9 NOT IN (1) AS canonical_related FROM pages""")
def redirect_paths(spark, d):
    rows = _hops(spark, d)
    related = evidence.canonical_related(F.concat(F.lit("http://b.example:80/"), "page_id"), F.regexp_replace("resolved_url", "^https", "http"), F.transform("chain", lambda c: F.regexp_replace(c, "^https", "http")))
    wrong = evidence.provenance_violation(F.col("url"), F.element_at("chain", -1), F.col("chain")) == "START_MISMATCH"
    return rows.select("page_id", evidence.path_kind(F.col("chain")).alias("path"), F.size(evidence.clean_chain(F.col("chain"))).alias("hops"), F.coalesce(wrong, F.lit(False)).alias("start_differs"), related.alias("canonical_related"))


@query("""
WITH p AS (SELECT page_id, 'Publisher ' || page_id AS name, regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN name ELSE host END AS display FROM p""")
def source_display(spark, d):
    host = urls.host(F.col("url"))
    declared = F.when(F.col("page_id") % 2 == 0, host).otherwise("elsewhere.invalid")
    return table(spark, d, "pages").select("page_id", evidence.source_display(F.concat(F.lit(" Publisher "), "page_id"), declared, host).alias("display"))


# ---- regions

_NAMES = """SELECT r_name AS name, 'REGION' AS kind, r_name AS region_id FROM {region} UNION ALL SELECT n_name, 'CITY', r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'Line ' || CAST(n_nationkey % 7 AS STRING), 'SYSTEM', r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT n_name || ' Metro', 'SYSTEM', r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"""
_UNCLEAR = "SELECT n_name AS name FROM {nation} WHERE n_nationkey % 6 = 5 UNION ALL SELECT 'Central Line'"
_DICT = f"""
nm AS ({duck(_NAMES)}), un AS ({duck(_UNCLEAR)}),
dc AS (SELECT coalesce(key, lower(name)) AS key, CASE WHEN n = 1 AND name IS NULL THEN ['REGION', 'CITY', 'SYSTEM'][k] ELSE 'AMBIGUOUS' END AS kind, CASE WHEN n = 1 AND name IS NULL THEN region END AS region_id
  FROM (SELECT lower(name) AS key, count(DISTINCT region_id) AS n, min(region_id) AS region, min(list_position(['REGION', 'CITY', 'SYSTEM'], kind)) AS k FROM nm GROUP BY 1) FULL JOIN un ON key = lower(name))"""


def _dictionary(spark, d):
    return places.dictionary(given(spark, d, _NAMES), given(spark, d, _UNCLEAR))


@query(f"WITH {_DICT} SELECT * FROM dc")
def region_dictionary(spark, d):
    return _dictionary(spark, d)


_VALUES = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'the ' || n_name || ' depot' WHEN 2 THEN n_name || '-x, ' || r_name WHEN 3 THEN 'pre' || n_name WHEN 4 THEN r_name || ' and AFRICA' ELSE 'Line ' || CAST(n_nationkey % 7 AS STRING) END AS value
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""
_LOOKED = f"""{_DICT}, vl AS ({duck(_VALUES)}),
fu AS (SELECT c_custkey, lower(value) AS v, dc.kind, dc.region_id FROM vl LEFT JOIN dc ON key = lower(value)),
ct AS (SELECT c_custkey, count(DISTINCT dc.region_id) AS n, min(list_position(['REGION', 'CITY', 'SYSTEM'], dc.kind)) AS k, min(dc.region_id) AS region FROM fu JOIN dc ON dc.kind <> 'AMBIGUOUS' AND key <> v AND length(key) >= 2
  AND regexp_matches(v, '(^|[^a-z0-9_])' || key || '($|[^a-z0-9_])') WHERE fu.kind IS NULL GROUP BY 1),
lk AS (SELECT c_custkey, coalesce(kind, CASE WHEN n = 1 THEN ['REGION', 'CITY', 'SYSTEM'][k] ELSE 'AMBIGUOUS' END) AS kind, CASE WHEN kind IS NOT NULL THEN region_id WHEN n = 1 THEN region END AS region_id FROM fu LEFT JOIN ct USING (c_custkey) WHERE kind IS NOT NULL OR n IS NOT NULL)"""


@query(f"WITH {_LOOKED} SELECT * FROM lk")
def region_lookup(spark, d):
    """Values as whole names, else by the names inside them."""
    return places.looked_up(given(spark, d, _VALUES), "c_custkey", "value", _dictionary(spark, d))


@query(f"""
WITH {_LOOKED}, fl AS (SELECT v.c_custkey, position, field, lk.kind, lk.region_id FROM (SELECT c_custkey, 1 AS position, 'country' AS field, c_custkey AS src FROM vl WHERE c_custkey % 4 <> 0 UNION ALL SELECT c_custkey, 3, 'location', (c_custkey * 7) % (SELECT count(*) FROM customer) FROM vl WHERE c_custkey % 5 <> 0) v
  LEFT JOIN lk ON lk.c_custkey = src),
ag AS (SELECT c_custkey, count(DISTINCT CASE WHEN kind <> 'AMBIGUOUS' THEN region_id END) AS n, min(CASE WHEN kind <> 'AMBIGUOUS' THEN region_id END) AS region, min(CASE WHEN kind <> 'AMBIGUOUS' THEN {{'mapped': kind <> 'REGION', 'position': position, 'field': field}} END) AS best, coalesce(bool_or(kind = 'AMBIGUOUS'), false) AS unclear FROM fl GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN region END AS region_id, CASE WHEN n IS NULL THEN 'NOT_STATED' WHEN n <> 1 THEN 'UNRESOLVED' WHEN best.mapped THEN 'REFERENCE_MAPPED' ELSE 'SOURCE_STATED' END AS basis, CASE WHEN n = 1 THEN best.field END AS source_field,
  CASE WHEN n > 1 THEN 'CONFLICTING_REGIONS' WHEN n = 1 OR n IS NULL THEN 'NONE' WHEN unclear THEN 'AMBIGUOUS_NAME' ELSE 'UNRECOGNIZED_VALUE' END AS diagnostic FROM vl LEFT JOIN ag USING (c_custkey)""")
def region_resolution(spark, d):
    """One region out of a customer's own value and that of another customer as a second field."""
    values = given(spark, d, _VALUES)
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    own = values.select("c_custkey", F.lit(1).alias("position"), F.lit("country").alias("field"), F.when(F.col("c_custkey") % 4 != 0, F.col("value")).otherwise(" ").alias("value"))
    other = values.crossJoin(F.broadcast(n)).select("c_custkey", ((F.col("c_custkey") * 7) % F.col("n")).alias("src")).where("c_custkey % 5 <> 0").join(values.select(F.col("c_custkey").alias("src"), "value"), "src")
    fields = own.unionByName(other.select("c_custkey", F.lit(3).alias("position"), F.lit("location").alias("field"), "value"))
    return places.resolved(fields, "c_custkey", _dictionary(spark, d))


@query(f"WITH {_DICT}, vl AS ({duck(_VALUES)}) SELECT c_custkey FROM vl WHERE lower(value) NOT IN (SELECT key FROM dc WHERE kind IN ('REGION', 'CITY')) AND lower(value) <> 'line 3'")
def specific_names(spark, d):
    """Values that are neither a region's or city's name nor a generic term."""
    generic = spark.createDataFrame([("LINE  3",)], "name string")
    return places.specific(given(spark, d, _VALUES), "value", _dictionary(spark, d), generic).select("c_custkey")
