"""Functions of this library in the session catalogue, so that SQL text can call them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import segments

#: Expressions in SQL: name, arguments, result, body.
EXPRESSIONS = (
    ("lookup_key", "value STRING", "STRING", r"lower(trim(regexp_replace(value, '\\s+', ' ')))"),
    ("week_start", "at TIMESTAMP", "DATE", "date_trunc('week', at + INTERVAL 8 HOURS)::DATE"),
    ("host_of", "url STRING", "STRING", r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"),
    ("clipped", "value STRING, most INT", "STRING", r"CASE WHEN length(regexp_replace(trim(value), '\\s+', ' ')) <= most THEN regexp_replace(trim(value), '\\s+', ' ') ELSE concat(rtrim(left(regexp_replace(trim(value), '\\s+', ' '), most - 1)), '…') END"),
)


class ProseUnits:
    """Table function: the units of a prose text, with number, begin and end."""

    def eval(self, text: str) -> Iterator[tuple]:
        for n, (begin, end) in enumerate(segments.unit_spans(text or "")):
            yield n + 1, begin, end, text[begin:end]


def _agreed(values: pa.Array) -> str:
    """The value that all agree on, or null."""
    distinct = values.drop_null().unique()
    return distinct[0].as_py() if len(distinct) == 1 else None


def register(spark: SparkSession) -> None:
    """Registers lookup_key, week_start, host_of and clipped (SQL functions), prose_units (a table function) and
    agreed (an aggregate; it sees a group's values at once, so give it distinct ones). Repeating it changes nothing."""
    for name, arguments, result, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("prose_units", F.udtf(ProseUnits, returnType="n int, begin int, `end` int, unit string"))
    spark.udf.register("agreed", F.arrow_udf(_agreed, "string"))
