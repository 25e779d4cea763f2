"""Tables in Parquet, and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever dots or quotes it holds."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="evidentia-")
        where = _own["dir"]
    return where.rstrip("/")


def written(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """df written to the shared folder and read again, with measures taken on the way: later jobs start
    from files, which survive the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/evidentia-{uuid.uuid4().hex}"
    seen = Observation()
    measures = {"rows": F.count(F.lit(1)), **measures}
    df.observe(seen, *[c.alias(k) for k, c in measures.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


#: Rows of a task where a step is dealt by keys.
PER_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df dealt by keys to a task for every PER_TASK of about so many rows: what a task holds doesn't grow with the tables.
    Rows are counted on the table that df comes from, which Parquet tells without reading it. A task holds a whole key."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PER_TASK)), *keys)
