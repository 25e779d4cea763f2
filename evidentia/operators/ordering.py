"""Positions and running sums inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """rows with the sum of the weights (1 each without them) that come before in their group.

    Rows are dealt by ranges of group and order, so that a large group is sorted by many tasks; sums of
    (group, range) then tell what stands before each range, and only these few rows meet in a window.
    order must be total for positions that repeat from run to run.
    """
    keys = [F.col(c) for c in group]
    ordered = [*keys, *order]
    spread = rows.withColumn("__weight", F.lit(1) if weight is None else weight).repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    placed, _ = written(spread.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sums = placed.groupBy(*keys, "__range").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__of_{k}") for k, c in enumerate(group)], F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(*group, "__range").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    same = placed["__range"] == sums["__of"]
    for k, c in enumerate(group):  # a null group is a group
        same &= placed[c].eqNullSafe(sums[f"__of_{k}"])
    found = placed.join(sums, same).withColumn(name, F.col("__base") + F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return found.select(*rows.columns, name)
