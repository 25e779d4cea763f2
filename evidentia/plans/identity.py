"""Queries of entity resolution: sources, conflicts, proposals, groups and what they come to.

Orders are records; a customer's orders of a week are an event.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import entities, identity
from ..sources.tables import table
from ._register import duck, given, query

_RECORDS = """SELECT o_orderkey AS candidate_id, CAST(o_custkey AS STRING) || ':' || CAST(CAST(o_orderdate AS DATE) AS STRING) AS group_id, 'HTTP://H' || CAST(o_orderkey % 97 AS STRING) || '.example/' || CASE WHEN o_orderkey % 2 = 0 THEN 'a/' ELSE '' END AS url,
  CASE WHEN o_orderkey % 3 = 0 THEN 'operator_notice' ELSE 'press' END AS source_role, o_orderstatus, o_orderpriority, CAST(o_custkey % 40 AS STRING) AS batch, o_custkey FROM {orders}"""


@query(f"""
WITH r AS ({duck(_RECORDS)}), k AS (SELECT candidate_id, lower(url) AS u, o_orderstatus, candidate_id % 5 AS f FROM r), l AS (SELECT u, o_orderstatus, f, min(candidate_id) AS left_id FROM k GROUP BY ALL)
SELECT left_id, candidate_id AS right_id FROM (SELECT candidate_id, regexp_replace(u, '/a/$', '/a') AS v, u, o_orderstatus, f FROM k) JOIN l USING (u, o_orderstatus, f) WHERE left_id <> candidate_id""")
def exact_source_pairs(spark, d):
    """Records of one page, text and focus, each with the first of its source."""
    rows = given(spark, d, _RECORDS)
    return identity.exact_source_pairs(rows, identity.source_key(F.col("url"), F.col("o_orderstatus"), F.array(F.concat(F.lit("S"), F.col("candidate_id") % 5))), "candidate_id")


_PAIRS = "SELECT o_orderkey AS left_id, l_partkey AS right_id FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"
_PLACED = "SELECT c_custkey AS candidate_id, CASE WHEN c_acctbal > 0 THEN r_name END AS region_id FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"


@query(f"""
WITH p AS ({duck(_PAIRS)}), g AS ({duck(_PLACED)}) SELECT left_id, right_id FROM p JOIN g a ON a.candidate_id = left_id JOIN g b ON b.candidate_id = right_id WHERE a.region_id <> b.region_id""")
def region_conflicts(spark, d):
    return identity.region_conflicts(given(spark, d, _PAIRS), given(spark, d, _PLACED))


_SAME = "SELECT l_orderkey AS left_id, l_orderkey + l_linenumber AS right_id, l_linenumber % 4 AS source FROM {lineitem}"


@query(f"""
WITH p AS ({duck(_SAME)}), b AS (SELECT left_id, right_id, min(source) AS rank FROM p GROUP BY 1, 2)
SELECT left_id, right_id, CASE WHEN rank = 0 THEN 'DISTINCT_EVENT' ELSE 'SAME_EVENT' END AS relation, ['CONFLICT', 'EXACT_SOURCE', 'EXACT_FACTS', 'AGREED_PROPOSAL'][rank + 1] AS reason FROM b""")
def pair_relations(spark, d):
    """Pairs that four sources name, by their precedence."""
    rows = given(spark, d, _SAME)
    return entities.relations(*[rows.where(F.col("source") == k).select("left_id", "right_id") for k in range(4)])


_VERDICTS = "SELECT l_suppkey AS left_id, l_suppkey + l_linenumber AS right_id, l_orderkey % 3 AS procedure_no, l_orderkey AS nomination, l_quantity > 20 AS same FROM {lineitem}"


@query(f"""
WITH v AS ({duck(_VERDICTS)}), f AS (SELECT procedure_no, left_id, right_id, arg_min(same, nomination) AS same FROM (SELECT procedure_no, left_id, right_id, nomination, bool_and(same) AS same FROM v GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT left_id, right_id, count(DISTINCT procedure_no) AS procedures FROM f WHERE same GROUP BY 1, 2 HAVING count(DISTINCT procedure_no) >= 2""")
def agreed_pairs(spark, d):
    """Pairs on whose first verdict two of three procedures agree."""
    rows = given(spark, d, _VERDICTS).groupBy(F.col("procedure_no").alias("procedure"), "left_id", "right_id", "nomination").agg(F.bool_and("same").alias("same"))
    return identity.agreed_pairs(rows)


_NOMINATED = "SELECT DISTINCT l_orderkey % 3 AS procedure, l_orderkey AS group_no, l_linenumber AS candidate_id, 1 AS lead FROM {lineitem}"
_CONFIRMED = "SELECT l_orderkey % 3 AS procedure, l_orderkey AS group_no, l_linenumber AS candidate_id, CASE WHEN l_linenumber < 4 THEN 1 ELSE 2 END AS part, min(l_quantity) > 10 AS valid FROM {lineitem} WHERE l_linenumber % 5 <> 0 GROUP BY l_orderkey, l_linenumber"


@query(f"""
WITH n AS ({duck(_NOMINATED)}), c AS ({duck(_CONFIRMED)}), l AS (SELECT group_no, part FROM c WHERE candidate_id = 1)
SELECT n.procedure, group_no, n.candidate_id, CASE WHEN c.part IS NULL THEN 'OMITTED' WHEN NOT valid THEN 'MEMBER_INVALID' WHEN c.part = l.part THEN 'PLACED' ELSE 'SEPARATED' END AS placement FROM n LEFT JOIN c USING (group_no, candidate_id) LEFT JOIN l USING (group_no)""")
def member_placements(spark, d):
    return identity.placements(given(spark, d, _NOMINATED), given(spark, d, _CONFIRMED))


_PROPOSED = "SELECT l_orderkey AS response_id, l_linenumber AS group_no, l_partkey AS candidate_id, CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS cites FROM {lineitem}"


@query(f"""
WITH p AS ({duck(_PROPOSED)}), u AS (SELECT DISTINCT response_id FROM p WHERE candidate_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 45))
SELECT response_id, group_no, candidate_id FROM p WHERE response_id NOT IN (SELECT response_id FROM u) GROUP BY ALL HAVING count(*) = 1 AND max(cites) > 0""")
def valid_proposals(spark, d):
    """Responses that name an unknown record are void; members that repeat or cite nothing drop out alone."""
    rows = given(spark, d, _PROPOSED).withColumn("cited", F.when(F.col("cites") > 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")))
    return entities.valid_proposals(rows, table(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("candidate_id")), table(spark, d, "lineitem").count())


@query(f"""
WITH r AS ({duck(_RECORDS)}), u AS (SELECT *, regexp_replace(lower(url), '([^/])/$', '\\1') AS k0 FROM r), k AS (SELECT *, CASE WHEN candidate_id % 2 = 0 THEN k0 ELSE lower(url) END AS k FROM u)
SELECT candidate_id, batch, row_number() OVER (PARTITION BY batch ORDER BY k, candidate_id) AS place, row_number() OVER (PARTITION BY batch ORDER BY k DESC, candidate_id DESC) AS place_reversed FROM k""")
def record_order(spark, d):
    """The order of records in the first nomination and, reversed, in the second."""
    return identity.records_in_order(given(spark, d, _RECORDS)).select("candidate_id", "batch", "place", "place_reversed")


@query("""
SELECT o_orderkey AS candidate_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + INTERVAL 1 HOUR END NULLS FIRST, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%-d ') || strftime(o_orderdate, '%b %Y') || ' 09:00:00 +0800' ELSE 'soon' END, o_orderkey) AS position FROM orders""")
def publication_order(spark, d):
    """Orders of a customer by their publication, unreadable ones first."""
    raw = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "d MMM yyyy '09:00:00 +0800'")).otherwise("soon")
    return identity.publication_order(table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), "o_custkey", raw.alias("published_at")), "o_custkey").select("candidate_id", "position")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, 'M' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 1000000 + l_suppkey) AS reference FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)""")
def short_references(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct().withColumn("k", F.col("l_partkey") * 1000000 + F.col("l_suppkey"))
    return identity.short_references(rows, "l_orderkey", "k", "M").drop("k")


@query("""
WITH p AS (SELECT source AS batch, t.tier, sum(least(length(text), t.most)) AS size FROM documents, (SELECT unnest([0, 1, 2, 3]) AS tier, unnest([900, 600, 450, 300]) AS most) t GROUP BY 1, 2)
SELECT batch, coalesce(min(CASE WHEN size <= 9000 THEN tier END), max(tier)) AS tier, coalesce(min(CASE WHEN size <= 9000 THEN {'tier': tier, 'size': size} END), max({'tier': tier, 'size': size})).size AS size FROM p GROUP BY batch""")
def request_tiers(spark, d):
    """The fullest tier in which the texts of a source fit into one request."""
    docs = table(spark, d, "documents").where("text is not null")
    sizes = F.array(*[F.struct(F.lit(k).alias("tier"), F.least(F.length("text"), F.lit(most)).alias("size")) for k, (_, most) in enumerate(identity.TIERS)])
    return identity.tier(docs.select(F.col("source").alias("batch"), F.explode(sizes).alias("s")).select("batch", "s.*"), "batch", 9000)


@query(f"""
WITH r AS ({duck(_RECORDS)}), f AS (SELECT group_id, list_sort(list(candidate_id)) AS ms, min({{'later': source_role <> 'operator_notice', 'url': CASE WHEN candidate_id % 2 = 0 THEN rtrim(lower(url), '/') ELSE lower(url) END, 'candidate_id': candidate_id}}) AS first,
  count(DISTINCT o_orderstatus) = 1 AS a, count(DISTINCT o_orderpriority) = 1 AS b FROM r GROUP BY 1)
SELECT group_id, 'evt_' || sha256('{{"members":[' || array_to_string(ms, ',') || ']}}')[1:24] AS event_id, array_to_string(ms, ',') AS member_ids, first.candidate_id AS canonical, concat_ws(',', CASE WHEN b THEN 'priority' END, CASE WHEN a THEN 'status' END) AS basis FROM f""")
def event_groups(spark, d):
    """Groups as events: members, canonical member, and the facts that all members state alike."""
    rows = given(spark, d, _RECORDS).withColumn("facts", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("none"), F.lit(" ")))
    found = identity.events(rows.select("group_id", "candidate_id"), rows.select("candidate_id", "url", "source_role", "facts"))
    return found.withColumn("member_ids", F.array_join("member_ids", ",")).withColumn("basis", F.array_join("basis", ","))


@query("""
WITH l AS (SELECT 'nomination ' || (l_linenumber % 2 + 1) || ' of procedure ' || (l_orderkey % 3) || ': ' || l_suppkey || ' pairs' AS line, l_linenumber % 2 + 1 AS n, l_orderkey % 3 AS p, l_suppkey AS k FROM lineitem)
SELECT p::INT AS procedure, n::INT AS nomination, sum(k)::BIGINT AS pairs FROM l GROUP BY 1, 2""")
def procedure_counts(spark, d):
    items = table(spark, d, "lineitem")
    line = F.concat(F.lit("nomination "), F.col("l_linenumber") % 2 + 1, F.lit(" of procedure "), F.col("l_orderkey") % 3, F.lit(": "), "l_suppkey", F.lit(" pairs"))
    return identity.procedure_counts(items.select(line.alias("line")).unionByName(items.limit(1).select(F.lit("something else").alias("line"))), "line")


@query(f"""
WITH r AS ({duck(_RECORDS)}), a AS (SELECT string_agg(candidate_id, ',' ORDER BY candidate_id) AS members FROM r GROUP BY group_id), b AS (SELECT string_agg(candidate_id, ',' ORDER BY candidate_id) AS members FROM r WHERE candidate_id % 50 <> 0 GROUP BY group_id)
SELECT members, 'found' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT members, 'recorded' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def replay_differences(spark, d):
    rows = given(spark, d, _RECORDS)
    return identity.replay_differences(rows, rows.where("candidate_id % 50 <> 0")).withColumn("members", F.array_join("members", ","))


@query(f"""
WITH r AS ({duck(_RECORDS)}), c AS (SELECT a.candidate_id AS left_id, b.candidate_id AS right_id, a.group_id = b.group_id AS together FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.candidate_id < b.candidate_id WHERE (a.candidate_id + b.candidate_id) % 3 <> 0)
SELECT * FROM c""")
def uncertain_pairs(spark, d):
    """Pairs of a customer's orders of one priority without a relation, and whether they ended together all the same."""
    rows = given(spark, d, _RECORDS)
    pairs = identity.pair_list(rows.select(F.concat_ws(":", "o_custkey", "o_orderpriority").alias("group_id"), "candidate_id"))
    return identity.uncertain_pairs(rows.select("group_id", "candidate_id"), pairs, pairs.where("(left_id + right_id) % 3 = 0"))


@query("""
WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER w AS running, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn FROM s WHERE n = 1 OR (n <= 6 AND running <= 900)""")
def leading_sentences(spark, d):
    number, budget = identity.TIERS[0]
    return identity.leading_sentences(table(spark, d, "conversations"), "conv_id", "turn", F.length("text"), number, budget).select("conv_id", "turn")


@query("""
WITH m AS (SELECT o_orderkey, o_custkey, date_trunc('week', o_orderdate)::DATE AS week FROM orders) SELECT o_orderkey, concat_ws(':', o_custkey, week) AS event_id, min(o_orderkey) OVER (PARTITION BY o_custkey, week) AS least FROM m""")
def event_members(spark, d):
    """Members of events with the least of their event."""
    from pyspark.sql import Window

    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", dates.week_start(F.col("o_orderdate").cast("date")).alias("week"))
    return rows.select("o_orderkey", F.concat_ws(":", "o_custkey", "week").alias("event_id"), F.min("o_orderkey").over(Window.partitionBy("o_custkey", "week")).alias("least"))


