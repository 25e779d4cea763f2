"""Outputs of a run that appear together or not at all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table of a run's outputs, which is written last: a run without it isn't there.
MANIFEST = "manifest"
_ROW = "output string, columns string, rows long"


def publish(outputs: dict[str, DataFrame], folder: str, run: str) -> None:
    """Writes the outputs of a run under folder, and then its manifest with their names, columns and rows.

    Each output is written by Spark, which commits its files when all tasks are done; readers look at the
    manifest, so they see all outputs of a run or none, whichever task, job or driver is lost on the way. Publishing a
    run again takes its manifest away first, and puts new outputs in the place of the old ones. Names are letters, digits, - and _.
    """
    for name in (run, *outputs):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name) or name == MANIFEST:
            raise ValueError(f"not the name of a run or an output: {name}")
    if not outputs:
        raise ValueError("a run has at least one output")
    spark = next(iter(outputs.values())).sparkSession
    place = f"{folder.rstrip('/')}/{run}"
    spark.createDataFrame([], _ROW).write.mode("overwrite").parquet(f"{place}/{MANIFEST}")
    rows = []
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{place}/{name}")
        rows.append((name, ",".join(df.columns), spark.read.schema(df.schema).parquet(f"{place}/{name}").count()))
    spark.createDataFrame(rows, _ROW).coalesce(1).write.mode("overwrite").parquet(f"{place}/{MANIFEST}")


def published(spark: SparkSession, folder: str, run: str) -> dict[str, DataFrame]:
    """The outputs of a run by name; none where it was not published whole, or where rows are missing since."""
    place = f"{folder.rstrip('/')}/{run}"
    try:
        listed = spark.read.schema(_ROW).parquet(f"{place}/{MANIFEST}").collect()  # a row for each output
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    found = {r.output: spark.read.parquet(f"{place}/{r.output}") for r in listed}
    return found if all(found[r.output].count() == r.rows for r in listed) else {}


def summary(outputs: dict[str, DataFrame], key: str) -> DataFrame:
    """output, rows and keys (distinct values of key) of each output."""
    every = None
    for name, df in outputs.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).select(F.lit(name).alias("output"), "rows", "keys")
        every = one if every is None else every.unionByName(one)
    return every
