"""Queries over sentences, units and quantities of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quantities, segments
from ..sources.tables import table
from ._register import duck, given, query

_SHORT = r"st|no|nos|mr|mrs|ms|dr|prof|co|corp|inc|ltd|jr|sr|vs|etc|fig|approx|dept|gov|rep|sen|gen|lt|col|capt|mt|ft|e\.g|i\.e|u\.s|u\.k|[^\PLß]"
_ASCII_END = r"""regexp_replace(%s, '([.!?][.!?」』）〕】》〉”’"'')\]]*)(\s+)([^\s0-9a-z])', '\1' || chr(1) || '\2\3', 'g')"""
_FULL_END = r"""regexp_replace(safe, '(\n|[。！？；][。！？；」』）〕】》〉”’"'')\]]*)', '\1' || chr(1), 'g')"""
_SENTENCES = rf"""
t AS (SELECT doc_id, regexp_replace(text, '(^|\s)(["''(“‘]*)({_SHORT})\.', '\1\2\3' || chr(2), 'gi') AS safe FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, string_split({_ASCII_END % (_ASCII_END % _FULL_END)}, chr(1)) AS p FROM t),
u AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS k FROM c),
o AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k)  - length(p) AS pos, regexp_replace(p, '^\s+|\s+$', '', 'g') AS bare, regexp_replace(p, '^\s+', '') AS rest FROM u),
sentence AS (SELECT doc_id, 'S' || row_number() OVER (PARTITION BY doc_id ORDER BY k) AS id, (pos + length(p) - length(rest))::INTEGER AS start,
  (pos + length(p) - length(rest) + length(bare))::INTEGER AS "end", replace(bare, chr(2), '.') AS text FROM o WHERE bare <> '')"""


@query(f"WITH {_SENTENCES} SELECT * FROM sentence")
def sentence_segments(spark, d):
    return segments.sentences(table(spark, d, "documents"), "doc_id", F.col("text"))


@query(f"""
WITH {_SENTENCES}, cites AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['S2', 'S1'] WHEN 1 THEN ['S1', 'S1'] WHEN 2 THEN ['S1', 'S999999'] ELSE [] END AS ids FROM documents),
l AS (SELECT doc_id, unnest(ids) AS id FROM cites),
g AS (SELECT l.doc_id, count(*) AS n, count(DISTINCT l.id) AS k, count(s.start) AS known, string_agg(s.text, ' ' ORDER BY s.start) AS cited FROM l LEFT JOIN sentence s USING (doc_id, id) GROUP BY 1)
SELECT doc_id, coalesce(n = k AND n = known, false) AS valid, CASE WHEN n = k AND n = known THEN cited END AS cited FROM cites LEFT JOIN g USING (doc_id)""")
def cited_sentences(spark, d):
    """Lists of sentence ids of each document: one in order, one that repeats, one that names an unknown sentence, an empty one."""
    docs = table(spark, d, "documents")
    name = lambda *ids: F.array(*[F.lit(i) for i in ids])
    kind = F.col("doc_id") % 4
    cites = docs.select("doc_id", F.when(kind == 0, name("S2", "S1")).when(kind == 1, name("S1", "S1")).when(kind == 2, name("S1", "S999999")).otherwise(F.array().cast("array<string>")).alias("ids"))
    return segments.cited(cites, segments.sentences(docs, "doc_id", F.col("text")), "doc_id")


@query(f"""
WITH {_SENTENCES} SELECT s.* FROM sentence s SEMI JOIN (SELECT doc_id, min(start) AS start, min("end") AS "end" FROM sentence GROUP BY 1 UNION ALL SELECT doc_id, 1, 2 FROM documents) f USING (doc_id, start, "end")""")
def focus_sentences(spark, d):
    """Sentences that are recorded as the focus of their document, here the first one; a span that is no sentence finds none."""
    found = segments.sentences(table(spark, d, "documents"), "doc_id", F.col("text"))
    focus = found.groupBy("doc_id").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    return segments.focused(found, focus.union(focus.select("doc_id", F.lit(1), F.lit(2))), "doc_id")


_UNITS = "SELECT p_partkey, p_name || '。' || CASE WHEN p_size % 2 = 0 THEN '！？」' ELSE '' END || p_brand || '；' || p_type AS said FROM {part}"


@query(f"""
WITH p AS ({duck(_UNITS)}), s AS (SELECT p_partkey, string_split(regexp_replace(said, '([。！？；][。！？；」]*)', '\\1' || chr(1), 'g'), chr(1)) AS x FROM p),
u AS (SELECT p_partkey, unnest(x) AS text, generate_subscripts(x, 1) AS k FROM s)
SELECT p_partkey, 'U' || k AS id, (sum(length(text)) OVER w - length(text))::INTEGER AS start, (sum(length(text)) OVER w)::INTEGER AS "end", text FROM u WINDOW w AS (PARTITION BY p_partkey ORDER BY k)""")
def prose_units(spark, d):
    """Units that make up a text exactly: full-width marks and newlines end one."""
    return segments.spans_of(given(spark, d, _UNITS), "p_partkey", F.col("said"), segments.unit_spans, "U")


@query()
def stated_quantities(spark, d):
    """Quantities of documents in the notation of each document; value tables are in the tests."""
    return quantities.stated(table(spark, d, "documents"), "doc_id", F.col("text"))


_PRICES = """SELECT l_orderkey * 10 + l_linenumber AS item, l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n,
  CASE l_linenumber % 4 WHEN 0 THEN 'It weighs ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' tonnes.' WHEN 1 THEN 'US$' || CAST(CAST(l_quantity AS INT) AS STRING) || ' million was paid.'
    WHEN 2 THEN 'From ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' to ' || CAST(CAST(l_quantity AS INT) + 5 AS STRING) || ' km.' ELSE 'A rise of ' || CAST(CAST(l_quantity AS INT) AS STRING) || '.5 percent' END AS said FROM {lineitem}"""
_STATED = f"""
p AS ({duck(_PRICES)}),
q AS (SELECT item, l_orderkey, 0 AS ordinal, CASE l_linenumber % 4 WHEN 0 THEN n || ' tonnes' WHEN 1 THEN n || ' million' WHEN 2 THEN n::VARCHAR ELSE n || '.5 percent' END AS raw,
  CASE l_linenumber % 4 WHEN 0 THEN n WHEN 1 THEN n * 1e6 WHEN 2 THEN n * 1000 ELSE n + 0.5 END::DOUBLE AS value,
  CASE l_linenumber % 4 WHEN 0 THEN 'mass' WHEN 1 THEN 'USD' WHEN 2 THEN 'length' ELSE 'percent' END AS unit,
  CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e6 WHEN 2 THEN 1000 ELSE 0.1 END::DOUBLE AS place FROM p
UNION ALL SELECT item, l_orderkey, 1, (n + 5) || ' km', ((n + 5) * 1000)::DOUBLE, 'length', 1000.0 FROM p WHERE l_linenumber % 4 = 2)"""


@query(f"WITH {_STATED} SELECT item, ordinal, raw, value, unit, place FROM q")
def quantities_in_prose(spark, d):
    """Quantities of a sentence made of each line item: masses, amounts, ranges, shares."""
    found = quantities.stated(given(spark, d, _PRICES), "item", F.col("said"))
    return found.withColumn("unit", F.array_join("unit", ","))


@query(f"""
WITH {_STATED}
SELECT item, value FROM q WHERE NOT EXISTS (SELECT 1 FROM q e WHERE e.l_orderkey = q.l_orderkey AND e.item % 2 = 1 - q.item % 2 AND e.unit = q.unit
  AND abs(e.value - q.value) <= q.place / 2 + 1e-9 * greatest(abs(e.value), 1.0))""")
def numeric_grounding(spark, d):
    """Quantities of a line item that no line item of its order with the other parity states, within the rounding of the last digit."""
    found = quantities.stated_by_text(given(spark, d, _PRICES), "item", F.col("said")).select("item", "value", "unit", "place")
    order, parity = F.expr("(item - pmod(item, 10)) div 10"), F.col("item") % 2
    own, other = (found.withColumn("side", order * 4 + side) for side in (parity, 1 - parity))
    return quantities.without_evidence(quantities.checked(own), other, "side").select("item", "value")
