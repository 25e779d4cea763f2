"""Registration of queries, and inputs that Spark and the SQL of a query share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def given(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """An input of a query: SQL that both engines read, with tables in braces."""
    return spark.sql(sql, **{name: table(spark, d, name) for name in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    """The same input as text inside the SQL of the query."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
