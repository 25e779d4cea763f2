"""Weekly counts of an event stream, Monday to Sunday, with late rows up to a day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir


def weekly(events: DataFrame) -> DataFrame:
    """Counts and sums by week and type. Works on a stream (with a watermark) and on a table."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", "1 day")
    # windows start on a Thursday by themselves: that was the first day of the epoch
    week = F.window("ts", "7 days", "7 days", "4 days")
    found = rows.groupBy(week.alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("week.start").cast("date").alias("week_start"), "event_type", "n")


def weekly_from_stream(spark: SparkSession, path: str) -> DataFrame:
    """Runs the stream over the files that are there. A batch writes the counts that it changed; the last ones are returned."""
    schema = spark.read.parquet(path).schema
    name, where = f"weekly_{uuid.uuid4().hex}", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    folder, _, pattern = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/epoch={epoch}")

    query = weekly(stream).writeStream.queryName(name).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/state").foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.parquet(f"{where}/out")
    return found.groupBy("week_start", "event_type").agg(F.max_by("n", "epoch").alias("n"))


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts of each type in windows that overlap. On a stream, rows whose windows have all closed (end before the
    greatest ts less delay) are too late and don't count."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if events.isStreaming else rows
    found = rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: runs of events with less than a gap between neighbours; they end a gap after the last."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if events.isStreaming else rows
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def appended(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """Runs a stream of windows to its end in append mode: only closed windows, each once."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = windows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").start()
    query.awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{where}/out")


def event_stream(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The files of a folder or a single file as a stream, so many files a batch."""
    folder, _, pattern = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
