"""Queries over feeds, bodies, recorded answers, staged outcomes, and functions called from SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import plain_json, sql
from ..functions.dates import LATENCY
from ..operators import audit_star, evidence_counts, integrity, outcomes, replay
from ..operators.outcomes import Stage
from ..operators.proposals import GATES
from ..sources import feeds, journal, outputs
from ..sources.tables import shared_dir, table
from ._register import duck, given, query

# a feed of each order, an item of each of its line items; every eleventh part repeats its title, every thirteenth has no link
_FEEDS = """SELECT l_orderkey AS feed_id, CASE l_orderkey % 9 WHEN 0 THEN '<rss><channel>' WHEN 1 THEN '<feed><channel>' ELSE '<?xml version="1.0"?><rss version="2.0"><channel><title>feed</title>' END
  || string_agg(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '<item><title>Part ' || CAST(l_partkey AS STRING) || ' &amp; more</title>' || CASE WHEN l_partkey % 211 = 0 THEN '<title>again</title>' ELSE '' END
    || CASE WHEN l_partkey % 193 = 0 THEN '' ELSE '<link> https://h.example/' || CAST(l_partkey AS STRING) || '</link>' END || '<source url=" https://s' || CAST(l_suppkey AS STRING) || '.example ">S' || CAST(l_suppkey AS STRING) || '</source></item>' END, '') WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey)
  || CASE l_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN '</channel></feed>' WHEN 2 THEN '</channel><channel/></rss>' ELSE '</channel></rss>' END AS body FROM {lineitem} GROUP BY l_orderkey"""
_FEED_STATE = """
i AS (SELECT l_orderkey AS feed_id, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k,
  CASE WHEN l_partkey % 211 = 0 THEN 'REPEATED_TITLE' WHEN l_partkey % 193 = 0 THEN 'MISSING_LINK' END AS fault FROM lineitem WHERE l_partkey % 5 > 0),
f AS (SELECT feed_id, count(*) AS n, arg_min(fault, k) FILTER (fault IS NOT NULL) AS fault FROM i GROUP BY 1),
s AS (SELECT l_orderkey AS feed_id, CASE l_orderkey % 9 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'UNEXPECTED_ROOT' WHEN 2 THEN 'CHANNELS' ELSE any_value(fault) END AS reason, coalesce(any_value(n), 0) AS n
  FROM lineitem LEFT JOIN f ON feed_id = l_orderkey GROUP BY l_orderkey)"""


@query(f"WITH {_FEED_STATE} SELECT feed_id, CASE WHEN reason IS NOT NULL THEN 'INVALID_RESPONSE' WHEN n > 0 THEN 'SUCCESS_WITH_RESULTS' ELSE 'SUCCESS_ZERO_RESULTS' END AS status, reason FROM s")
def feed_documents(spark, d):
    """Feeds taken whole or not at all."""
    return feeds.feed_documents(given(spark, d, _FEEDS)).select("feed_id", "status", "reason")


@query(f"""
WITH {_FEED_STATE} SELECT i.feed_id, (row_number() OVER (PARTITION BY i.feed_id ORDER BY k) - 1)::INTEGER AS ordinal, 'Part ' || l_partkey || ' & more' AS title, ' https://h.example/' || l_partkey AS link, 'S' || l_suppkey AS publisher,
  '' AS published, '' AS snippet, 'https://s' || l_suppkey || '.example' AS publisher_url FROM i JOIN s USING (feed_id) WHERE reason IS NULL""")
def feed_entries(spark, d):
    return feeds.feed_items(given(spark, d, _FEEDS))


_BODIES = """SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=ISO-8859-1' WHEN 1 THEN 'text/html; charset=unknown-9' ELSE 'text/html' END AS kind,
  CASE WHEN page_id % 4 = 2 THEN '<meta http-equiv="c" content="text/html; charset=latin1">' ELSE '' END || 'Größe ' || CAST(page_id AS STRING) AS said FROM {pages}"""


@query(f"WITH b AS ({duck(_BODIES)}) SELECT page_id, CASE WHEN page_id % 4 IN (0, 2) THEN 'ISO-8859-1' ELSE 'UTF-8' END AS charset, said FROM b")
def decoded_bodies(spark, d):
    """Bodies in the charset of their header, of their meta tag, or UTF-8 where neither names one that is known."""
    rows = given(spark, d, _BODIES).withColumn("body", F.when(F.col("page_id") % 2 == 0, F.encode("said", "ISO-8859-1")).otherwise(F.encode("said", "UTF-8")))
    return rows.select("page_id", feeds.charset(F.col("body"), F.col("kind")).alias("charset"), feeds.decoded(F.col("body"), F.col("kind")).alias("said"))


@query("SELECT p_partkey AS page_id, 0::INTEGER AS ordinal, p_name AS name, p_size::INTEGER AS size FROM part UNION ALL SELECT p_partkey, 1, p_brand, NULL FROM part")
def embedded_entries(spark, d):
    """Entries of a catalogue that a page embeds as JSON."""
    listed = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")), F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("int").alias("size"))))
    html = F.concat(F.lit('<html><head><script type="application/json">'), listed, F.lit("</script></head>"))
    pages = table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    return feeds.embedded_entries(pages, "struct<name:string,size:int>").select("page_id", "ordinal", "entry.name", "entry.size")


_CALLS = """SELECT o_orderkey AS k, 'kind' || CAST(o_custkey % 3 AS STRING) AS kind, 'request ' || CAST(o_orderkey % 5000 AS STRING) AS request, 'answer ' || CAST(o_orderkey % 5000 AS STRING) AS response, o_orderkey % 4 = 0 AS definitive FROM {orders}"""


@query(f"""
WITH c AS ({duck(_CALLS)}), j AS (SELECT DISTINCT kind, request, response FROM c WHERE definitive),
r AS (SELECT k, c.kind, c.request, j.response, substr(c.request, length(c.request)) = '6' AS changed FROM c LEFT JOIN j USING (kind, request)),
n AS (SELECT *, coalesce(sum((response IS NULL)::INTEGER) OVER (PARTITION BY kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS charged FROM r)
SELECT k, CASE WHEN NOT changed THEN response END AS response, CASE WHEN response IS NOT NULL THEN CASE WHEN changed THEN 'TAMPERED' ELSE 'REPLAYED' END WHEN charged < CASE kind WHEN 'kind0' THEN 100 WHEN 'kind1' THEN 7 ELSE 0 END THEN 'LIVE' ELSE 'OVER_BUDGET' END AS source FROM n""")
def journal_replay(spark, d):
    """A run over the journal of an earlier one; records of requests that end in 6 were changed."""
    calls = given(spark, d, _CALLS)
    held = journal.records(calls).withColumn("response", F.when(F.endswith("response", F.lit("6")), F.concat("response", F.lit("!"))).otherwise(F.col("response")))
    return journal.replay(calls.select("k", "kind", "request"), held, {"kind0": 100, "kind1": 7}, "k").select("k", "response", "source")


_STAGED = "SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, l_quantity, l_discount, l_returnflag FROM {lineitem}"


@query(f"""
WITH r AS ({duck(_STAGED)}) SELECT k, CASE WHEN l_quantity > 45 THEN 'scope' WHEN l_discount > 0.08 THEN 'category' WHEN l_returnflag = 'R' THEN 'writer' END AS stage,
  CASE WHEN l_quantity > 45 THEN CASE WHEN l_partkey % 2 = 0 THEN 'TIMEOUT' ELSE 'NO_ANSWER' END WHEN l_discount > 0.08 THEN 'UNRESOLVED' WHEN l_returnflag = 'R' THEN 'INVALID' END AS reason FROM r""")
def staged_outcomes(spark, d):
    """Subjects of a run: its results, and for the others the gap of the first stage that failed them."""
    stages = (
        Stage("scope", F.when(F.col("l_quantity") > 45, F.when(F.col("l_partkey") % 2 == 0, "TIMEOUT").otherwise("NO_ANSWER"))),
        Stage("category", F.when(F.col("l_discount") > 0.08, "UNRESOLVED")), Stage("writer", F.when(F.col("l_returnflag") == "R", "INVALID"), aborts=F.col("l_quantity") < 0),
    )
    results, gaps = outcomes.split(given(spark, d, _STAGED), "k", stages)
    return results.select("k", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("reason")).unionByName(gaps)


@query("""
WITH u AS (SELECT o_orderkey, unnest(string_split(o_orderpriority || '。' || o_orderstatus || 'x', '。')) AS unit, unnest(range(2)) AS k, 'HTTPS://User@H' || o_custkey % 5 || '.Example:80/a' AS url, o_orderdate::TIMESTAMP AS tm, o_orderpriority FROM orders)
SELECT lower(o_orderpriority) AS priority, date_trunc('week', tm + INTERVAL 8 HOURS)::DATE AS week, 'h' || right(split_part(url, '.', 1), 1) || '.example' AS host, count(*) AS units, sum(length(unit) + 1 - k)::BIGINT AS characters,
  CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS agreed_unit FROM u GROUP BY ALL""")
def registered_functions(spark, d):
    """SQL text alone: SQL functions, a table function and an aggregate of the session catalogue."""
    sql.register(spark)
    return spark.sql(
        """
        WITH u AS (
          SELECT lookup_key(concat(' ', o_orderpriority, '  ')) AS priority, week_start(CAST(o_orderdate AS TIMESTAMP)) AS week, host_of(concat('HTTPS://User@H', o_custkey % 5, '.Example:80/a')) AS host, p.unit
          FROM {orders} o, LATERAL prose_units(concat(o.o_orderpriority, '。', o.o_orderstatus, 'x')) p),
        n AS (SELECT priority, week, host, count(*) AS units, sum(length(unit)) AS characters FROM u GROUP BY ALL),
        a AS (SELECT priority, week, host, agreed(unit) AS agreed_unit FROM (SELECT DISTINCT priority, week, host, rtrim('。', unit) AS unit FROM u) GROUP BY ALL)
        SELECT priority, week, host, units, characters, agreed_unit FROM n JOIN a USING (priority, week, host)""",
        orders=table(spark, d, "orders"),
    )


_EVIDENCE = """SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS pos, CASE WHEN l_quantity > 30 THEN 'READY' ELSE 'REJECTED' END AS state,
  CASE WHEN l_quantity <= 30 AND l_partkey % 3 > 0 THEN 'R' || CAST(l_partkey % 5 AS STRING) END AS reject_reason,
  CASE l_suppkey % 5 WHEN 0 THEN 'URL_VALIDATION' WHEN 1 THEN 'HTTP_STATUS' WHEN 2 THEN 'SOURCE_PROVENANCE' WHEN 3 THEN 'FACTUAL_SUBSTANCE' ELSE 'SEMANTIC_MATCH' END AS gate,
  CASE WHEN l_linenumber < 6 THEN 200 + l_linenumber END AS status_code, CASE WHEN l_partkey % 7 = 0 THEN 'timeout' END AS transport_error, CASE WHEN l_partkey % 4 = 0 THEN 'Text/HTML; charset=x' ELSE '' END AS content_type,
  CASE WHEN l_partkey % 11 = 0 THEN 'no plain token!' WHEN l_partkey % 2 = 0 THEN 'READY' END AS document_status, 'kind' || l_returnflag AS page_kind, CASE WHEN l_partkey % 3 = 0 THEN 'MATCH' END AS source_provenance,
  CASE WHEN l_linenumber % 2 = 0 THEN 'true' END AS canonical_related, CASE WHEN l_linenumber % 3 = 0 THEN 'true' END AS body_available, CAST(NULL AS STRING) AS factual_substance,
  CASE WHEN l_partkey % 5 = 0 THEN 'SAME_EVENT' END AS relation, CASE WHEN l_partkey % 6 = 0 THEN 'valid' END AS validation, CASE WHEN l_partkey % 8 = 0 THEN 'DONE' END AS metadata_status,
  'https://www.H' || CAST(l_suppkey AS STRING) || '.example/a' AS candidate_url, CASE WHEN l_suppkey % 3 > 0 THEN 'https://h' || CAST(l_suppkey + l_suppkey % 2 AS STRING) || '.example/b' END AS resolved_url,
  l_linenumber * 4 AS hops, CAST(l_quantity AS INT) * 100 AS elapsed_ms, 'DIRECT' AS path, l_returnflag AS final_endpoint, l_linestatus AS consistency, 'h' || CAST(l_partkey % 40 AS STRING) AS initial_host,
  CASE WHEN l_partkey % 9 = 0 THEN 'f' || CAST(l_partkey % 10 AS STRING) END AS failing_host, CAST(NULL AS STRING) AS mismatch FROM {lineitem}"""
_BEHIND = {"transport_error": 2, "principal_document_status": 6, "source_provenance": 5, "canonical_related": 5, "body_available": 6, "factual_substance": 8, "semantic_relation": 9, "semantic_response_validation": 9}
_NAMES = {"principal_document_status": "document_status", "semantic_relation": "relation", "semantic_response_validation": "validation"}


def _counts_sql() -> str:
    gates = ", ".join(f"'{g}'" for g in GATES)
    token = lambda c: f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN regexp_full_match({c}::VARCHAR, '[A-Za-z0-9_.:/-]{{1,96}}') THEN {c}::VARCHAR ELSE 'UNKNOWN' END END"
    host = lambda c: f"nullif(regexp_replace(regexp_extract(lower({c}), '://([^/]*)', 1), '^www\\.', ''), '')"
    one = {
        "ready_count": "CASE WHEN state = 'READY' THEN 'READY' END", "rejected_count": "CASE WHEN state <> 'READY' THEN 'REJECTED' END", "reject_reason": "CASE WHEN state <> 'READY' THEN coalesce(reject_reason, 'UNKNOWN') END",
        "rejection_gate": "CASE WHEN state <> 'READY' THEN gate END", "reason_gate": "CASE WHEN state <> 'READY' THEN coalesce(reject_reason, 'UNKNOWN') || '|' || gate END", "http_status": "status_code::VARCHAR",
        "content_type": "CASE WHEN content_type <> '' THEN lower(split_part(content_type, ';', 1)) END", "page_kind": token("page_kind"), "metadata_extraction_status": "coalesce(metadata_status, CASE WHEN state <> 'READY' THEN 'NOT_REACHED' END)",
        "candidate_hostname": host("candidate_url"), "resolved_hostname": host("resolved_url"), "redirect_hop_count": "CASE WHEN hops <= 20 THEN hops::VARCHAR ELSE '20+' END",
        "host_transition": f"CASE WHEN resolved_url IS NULL THEN 'RESOLVED_HOST_MISSING' WHEN {host('candidate_url')} = {host('resolved_url')} THEN 'SAME_HOST' ELSE 'CHANGED_HOST' END",
        "acquisition_path": "path", "acquisition_final_endpoint": "final_endpoint", "acquisition_redirect_consistency": "consistency", "acquisition_initial_hostname": "initial_host", "acquisition_failing_endpoint_hostname": "failing_host", "source_provenance_mismatch": "mismatch",
    }
    low = "0"
    buckets = ""
    for high in LATENCY:
        buckets += f" WHEN elapsed_ms < {high} THEN '{low}-{high - 1}ms'"
        low = str(high)
    one["acquisition_latency_bucket"] = f"CASE{buckets} ELSE '{low}ms+' END"
    for name, after in _BEHIND.items():
        one[name] = f"coalesce({token(_NAMES.get(name, name))}, CASE WHEN list_position([{gates}], gate) < {after} THEN 'NOT_REACHED' END)"
    signature = ("rejection_gate", "http_status", "transport_error", "content_type", "principal_document_status", "page_kind", "source_provenance", "canonical_related", "body_available", "factual_substance", "semantic_relation", "semantic_response_validation", "host_transition", "acquisition_path")
    one["rejection_signature"] = "CASE WHEN state <> 'READY' THEN concat_ws(';', " + ", ".join(f"coalesce({one[p]}, '-')" for p in signature) + ") END"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS dimension, {v} AS value, pos FROM e" for k, v in one.items())
    return f"""WITH e AS ({duck(_EVIDENCE)}), v AS ({rows}), c AS (SELECT dimension, value, count(*) AS n, min(pos) AS first FROM v WHERE value IS NOT NULL GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY first, value) AS place FROM c)
    SELECT dimension, CASE WHEN place > 31 AND dimension IN ('candidate_hostname', 'resolved_hostname', 'acquisition_initial_hostname', 'acquisition_failing_endpoint_hostname') THEN 'OTHER' ELSE value END AS value, sum(n)::BIGINT AS n FROM k GROUP BY ALL"""


@query(_counts_sql())
def evidence_distributions(spark, d):
    """27 distributions of evidence and its two counts, in one pass over line items as evidence."""
    return evidence_counts.evidence_distributions(given(spark, d, _EVIDENCE), "pos")


@query("""
WITH i AS (SELECT l_orderkey, '[' || string_agg('{"line": ' || l_linenumber || ', "flag": "' || l_returnflag || '", "quantity": ' || l_quantity::INTEGER || '.0, "none": null}', ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity::INTEGER) || ']' AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey, length(t)::BIGINT AS size, sha256(t) AS text_sha256 FROM (SELECT o_orderkey, '{"id": ' || o_orderkey || ', "said": "tab\\t \\"' || o_orderpriority || '\\" 億\\n", "day": "' || strftime(o_orderdate, '%Y-%m-%d') || '", "open": ' || CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END
  || ', "items": ' || items || '}' AS t FROM orders JOIN i ON l_orderkey = o_orderkey)""")
def payload_sizes(spark, d):
    """Orders with their line items as nested rows: the size and hash of their JSON text."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").cast("double").alias("quantity"), F.lit(None).cast("string").alias("none"))
    sort = F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["line"]).alias("items"))  # an order has few lines
    said = F.concat(F.lit('tab\t "'), "o_orderpriority", F.lit('" 億\n'))
    record = F.struct(F.col("o_orderkey").alias("id"), said.alias("said"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "O").alias("open"), "items")
    rows = table(spark, d, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", record.alias("r"))
    kind = rows.schema["r"].dataType
    said = rows.select("o_orderkey", plain_json.plain(F.col("r"), kind).alias("t"))
    return said.select("o_orderkey", F.length("t").cast("long").alias("size"), F.sha2("t", 256).alias("text_sha256"))


@query("""
SELECT 'orders' AS output, count(*) AS rows, count(DISTINCT o_custkey) AS keys FROM orders UNION ALL SELECT 'customers', count(*), count(DISTINCT c_custkey) FROM customer""")
def published_outputs(spark, d):
    """Two outputs of a run, published together and read from there."""
    folder, run = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}", "run"
    named = {"orders": table(spark, d, "orders").withColumnRenamed("o_custkey", "key"), "customers": table(spark, d, "customer").withColumnRenamed("c_custkey", "key")}
    outputs.publish(named, folder, run)
    return outputs.summary(outputs.published(spark, folder, run), "key")


_STAR = """SELECT p_partkey AS candidate_id, p_size AS a, p_partkey % 17 AS b, p_partkey % 23 AS c, p_brand FROM {part}"""
_GOOD = dict(audit_star.STAGES)
# a part takes part in a stage by its size, is stopped there by its key, and every seventh leaves a gap instead
_SIDES = {n: f"SELECT candidate_id, CASE WHEN b = {k} THEN 'STOPPED' ELSE '{good}' END AS state, CASE WHEN b = {k} THEN 'why ' || p_brand END AS reason FROM s WHERE a > {3 * k} AND c <> {k}" for k, (n, good) in enumerate(audit_star.STAGES)}


def _star_sql() -> str:
    sides = ", ".join(f"x_{n} AS ({sql_})" for n, sql_ in _SIDES.items())
    joins = " ".join(f"LEFT JOIN x_{n} ON x_{n}.candidate_id = s.candidate_id LEFT JOIN gap g_{n} ON g_{n}.candidate_id = s.candidate_id AND g_{n}.stage = '{n}'" for n, _ in audit_star.STAGES)
    case = lambda gap, missing, other, end: "CASE " + " ".join(f"WHEN g_{n}.reason IS NOT NULL THEN {gap(n)} WHEN x_{n}.state IS NULL THEN {missing(n)} WHEN x_{n}.state <> '{good}' THEN {other(n)}" for n, good in audit_star.STAGES) + f" ELSE {end} END"
    said = lambda n: f"'{n}'"
    states = " || ".join(f"coalesce(',\"{n}\":\"' || x_{n}.state || '\"', '')" for n, _ in audit_star.STAGES)
    return f"""WITH s AS ({duck(_STAR)}), {sides}, gap AS (SELECT candidate_id, CASE c WHEN 0 THEN 'evidence' WHEN 3 THEN 'identity' ELSE 'writer' END AS stage, 'TIMEOUT' AS reason FROM s WHERE c IN (0, 3, 8) AND candidate_id % 7 = 0)
    SELECT s.candidate_id, {case(said, said, said, "'writer'")} AS terminal_stage, {case(lambda n: "'TECHNICAL_GAP'", lambda n: "'NOT_REACHED'", lambda n: f"x_{n}.state", "'REPORTED'")} AS terminal_state,
      {case(lambda n: f"g_{n}.reason", lambda n: "NULL", lambda n: f"x_{n}.reason", "NULL")} AS reason, '{{' || substr({states}, 2) || '}}' AS states FROM s {joins}"""


@query(_star_sql())
def selection_audit(spark, d):
    """Parts as candidates with nine stages: where each of them ended."""
    s = given(spark, d, _STAR)
    sides = {n: spark.sql(sql_.replace("FROM s", "FROM {s}"), s=s) for n, sql_ in _SIDES.items()}
    stage = F.when(F.col("c") == 0, "evidence").when(F.col("c") == 3, "identity").otherwise("writer")
    gaps = s.where("c in (0, 3, 8) and candidate_id % 7 = 0").select("candidate_id", stage.alias("stage"), F.lit("TIMEOUT").alias("reason"))
    return audit_star.selection(audit_star.star(s, sides, gaps))


@query("""
SELECT o_orderkey AS candidate_id, CASE WHEN o_orderkey % 13 = 0 THEN 'UNSUPPORTED_VERSION' WHEN o_orderkey % 11 = 0 THEN 'SOURCE_CONTENT_DIGEST_MISMATCH' WHEN o_orderkey % 7 = 0 THEN 'REQUEST_IDENTITY_DIGEST_MISMATCH'
    WHEN o_orderkey % 5 = 0 THEN 'NO_REPLAYABLE_PARSED_PROPOSAL' WHEN o_orderkey % 3 = 0 THEN 'PROPOSAL_DIGEST_MISMATCH' END AS reason,
  CASE WHEN o_orderkey % 13 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 5 = 0 THEN 'BLOCKED' WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 'FAIL' ELSE 'READY' END AS status,
  sha256('{"state": "' || o_orderstatus || '", "score": ' || o_orderkey % 9 || '}') AS proposal_sha256 FROM orders WHERE o_orderkey % 5 > 0 UNION ALL
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'UNSUPPORTED_VERSION' WHEN o_orderkey % 11 = 0 THEN 'SOURCE_CONTENT_DIGEST_MISMATCH' WHEN o_orderkey % 7 = 0 THEN 'REQUEST_IDENTITY_DIGEST_MISMATCH' ELSE 'NO_REPLAYABLE_PARSED_PROPOSAL' END,
  CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN 'FAIL' ELSE 'BLOCKED' END, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def replayed_proposals(spark, d):
    """Orders as saved proposals, some of which were changed since."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    proposal = F.when(k % 5 > 0, F.struct(F.col("o_orderstatus").alias("state"), (k % 9).alias("score")))
    rows = o.select(k.alias("candidate_id"), F.col("o_orderpriority").alias("title"), F.concat_ws(" ", "o_orderstatus", "o_custkey").alias("content"), F.struct("o_orderdate", "o_custkey").alias("metadata"), proposal.alias("proposal"), F.when(k % 5 > 0, "PARSED").otherwise("INVALID").alias("parse_status"))
    k = F.col("candidate_id")
    kept = replay.saved(rows).withColumns({
        "version": F.when(k % 13 == 0, "scope-v0").otherwise(F.col("version")), "content": F.when(k % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")),
        "title": F.when(k % 7 == 0, "another title").otherwise(F.col("title")), "proposal": F.when(k % 3 == 0, F.col("proposal").withField("score", F.col("proposal.score") + 1)).otherwise(F.col("proposal")),
    })
    return replay.replayable(kept).select("candidate_id", "reason", "status", "proposal_sha256")


@query("""
WITH e AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN sha256(p_brand) ELSE p_partkey::VARCHAR END AS key, CASE WHEN p_partkey % 6 > 0 THEN p_size % 13 + 1 ELSE 1 END AS i, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS region FROM part),
m AS (SELECT key, max(i) AS n FROM e GROUP BY 1),
b AS (SELECT key, list_transform(range(1, n + 1), lambda x: key || ' sentence ' || x || '.') AS lines FROM m)
SELECT p_partkey AS candidate_id, key AS content_key, array_to_string(lines, chr(10)) || coalesce(chr(10) || 'Region ' || region, '') AS body,
  coalesce(list_sum(list_transform(lines[1:i - 1], lambda x: length(x) + 1)), 0)::INTEGER AS focus_start, lines[i] AS focus_text FROM e JOIN b USING (key)""")
def rebuilt_records(spark, d):
    """Records rebuilt from what an audit keeps; parts of a brand are of one content."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    cited = F.when(k % 6 > 0, F.array(F.concat(F.lit("S"), (F.col("p_size") % 13 + 1).cast("string"))))
    found = replay.rebuilt(p.select(k.alias("candidate_id"), F.when(k % 4 > 0, F.sha2("p_brand", 256)).alias("content_sha256"), cited.alias("excerpt"), F.when(k % 3 == 0, F.col("p_type")).alias("region_id")))
    focus = F.col("focus")[0]
    return found.select("candidate_id", "content_key", "body", focus["start"].alias("focus_start"), F.substring("body", focus["start"] + 1, focus["end"] - focus["start"]).alias("focus_text"))


_RUN = "SELECT p_partkey AS candidate_id, p_partkey AS position, p_size FROM {part}"
_ANSWERS = """
  SELECT 'evidence' AS stage, p_partkey AS candidate_id, CASE WHEN p_size > 5 THEN 'READY' ELSE 'REJECTED' END AS state, p_partkey + CASE WHEN p_partkey % 100 = 0 THEN 2 ELSE 0 END AS position FROM {part} WHERE p_partkey % 41 > 0
  UNION ALL SELECT 'evidence', p_partkey, 'REJECTED', p_partkey FROM {part} WHERE p_partkey % 61 = 0 AND p_size <= 5
  UNION ALL SELECT 'scope', p_partkey, CASE WHEN p_size % 2 = 0 THEN 'IN_SCOPE' ELSE 'OUT' END, p_partkey FROM {part} WHERE p_size > 4 AND p_partkey % 41 > 0 AND p_partkey % 43 > 0
  UNION ALL SELECT 'identity', p_partkey, 'GROUPED', p_partkey FROM {part} WHERE p_size = 30
  UNION ALL SELECT 'unheard', p_partkey, 'X', p_partkey FROM {part} WHERE p_size = 1"""
_GAPS = """
  SELECT 'evidence' AS stage, p_partkey AS subject_id, 'TIMEOUT' AS failure_class FROM {part} WHERE p_partkey % 82 = 0 OR p_partkey % 97 = 0
  UNION ALL SELECT 'scope', p_partkey, 'TIMEOUT' FROM {part} WHERE p_partkey % 43 = 0 UNION ALL SELECT 'scope', p_partkey, 'NO_ANSWER' FROM {part} WHERE p_partkey % 86 = 0"""


@query(f"""
WITH c AS ({duck(_RUN)}), r AS ({duck(_ANSWERS)}), g AS ({duck(_GAPS)}),
i AS (SELECT 'evidence' AS stage, candidate_id, position FROM c UNION ALL SELECT 'scope', candidate_id, position FROM r WHERE stage = 'evidence' AND state = 'READY'
  UNION ALL SELECT 'temporal', candidate_id, position FROM r WHERE stage = 'scope' AND state = 'IN_SCOPE'),
ni AS (SELECT stage, candidate_id, min(position) AS input_at FROM i GROUP BY ALL), nr AS (SELECT stage, candidate_id, count(*) AS n, min(position) AS result_at FROM r WHERE stage <> 'unheard' GROUP BY ALL),
ng AS (SELECT stage, subject_id AS candidate_id, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT stage, candidate_id FROM ni UNION SELECT stage, candidate_id FROM nr UNION SELECT stage, candidate_id FROM ng),
m AS (SELECT k.stage, k.candidate_id, input_at, result_at, coalesce(nr.n, 0) AS results, coalesce(ng.n, 0) AS gaps FROM k LEFT JOIN ni USING (stage, candidate_id) LEFT JOIN nr USING (stage, candidate_id) LEFT JOIN ng USING (stage, candidate_id)),
o AS (SELECT stage, candidate_id, row_number() OVER (PARTITION BY stage ORDER BY input_at, candidate_id) AS a, row_number() OVER (PARTITION BY stage ORDER BY result_at, candidate_id) AS b FROM m WHERE input_at IS NOT NULL AND results > 0 AND gaps = 0)
SELECT stage, candidate_id, 'REPEATED_RESULT' AS fault FROM m WHERE results > 1 UNION ALL SELECT stage, candidate_id, 'REPEATED_GAP' FROM m WHERE gaps > 1
UNION ALL SELECT stage, candidate_id, 'NO_RESULT' FROM m WHERE input_at IS NOT NULL AND results = 0 AND gaps = 0 AND stage <> 'temporal'
UNION ALL SELECT stage, candidate_id, 'RESULT_DESPITE_GAP' FROM m WHERE input_at IS NOT NULL AND results > 0 AND gaps > 0
UNION ALL SELECT stage, candidate_id, 'NO_INPUT' FROM m WHERE input_at IS NULL AND results > 0 UNION ALL SELECT stage, candidate_id, 'UNKNOWN_SUBJECT' FROM m WHERE input_at IS NULL AND gaps > 0
UNION ALL SELECT stage, candidate_id, 'OUT_OF_ORDER' FROM o WHERE a <> b UNION ALL SELECT stage, candidate_id, 'UNKNOWN_STAGE' FROM r WHERE stage = 'unheard'
UNION ALL SELECT 'identity', NULL, 'NO_PREDECESSOR' FROM (SELECT 1 FROM r WHERE stage = 'identity' LIMIT 1)""")
def run_faults(spark, d):
    """A run over parts with results and gaps of its stages, into which faults of every kind were put."""
    return integrity.run_faults(given(spark, d, _RUN), given(spark, d, _ANSWERS), given(spark, d, _GAPS))
