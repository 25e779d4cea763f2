"""Distributions, votes, agreements and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Counts of the values that aren't null."""
    return rows.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def distributions(rows: DataFrame, **values: Column) -> DataFrame:
    """Distributions of several expressions in one pass: dimension, value, n."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("string").alias("value")) for k, v in values.items()])
    return (
        rows.select(F.explode(pairs).alias("p")).select("p.dimension", "p.value").where("value is not null")
        .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def top(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent rows of a distribution; ties in the order of the key."""
    return counts.orderBy(F.desc("n"), key).limit(k)


def capped_by_first_seen(rows: DataFrame, key: str, position: str, cap: int) -> DataFrame:
    """Distribution of key, in which only the cap values that were seen first have rows of their own.

    Only distinct values are ranked, after their rows are summed up.
    """
    seen = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    early = seen.orderBy("first", key).limit(cap).select(F.col(key).alias("__early"))
    named = seen.join(early, seen[key] == early["__early"], "left")
    return named.groupBy(F.coalesce(F.col("__early").cast("string"), F.lit("OTHER")).alias(key)).agg(F.sum("n").alias("n"))


def signatures(rows: DataFrame, *parts: Column) -> DataFrame:
    """Counts of composite keys; null parts are left out."""
    return rows.groupBy(F.concat_ws(";", *parts).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def agreed(votes: DataFrame, keys: Sequence[str], procedure: str, least: int = 2) -> DataFrame:
    """Keys that at least so many different procedures confirm."""
    return votes.groupBy(*keys).agg(F.count_distinct(procedure).alias("procedures")).where(F.col("procedures") >= least)


def one_or_conflict(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value where all rows agree, and diagnostic: NONE, NOT_STATED or CONFLICT."""
    found = rows.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias("__least"))
    return found.select(
        key, F.when(F.col("__n") == 1, F.col("__least")).alias(value),
        F.when(F.col("__n") == 0, "NOT_STATED").when(F.col("__n") == 1, "NONE").otherwise("CONFLICT").alias("diagnostic"),
    )


def unresolved_claims(claims: DataFrame, group: str, claim: str, value: str, member: str) -> DataFrame:
    """Claims of a group on which members differ: group, claim, versions (distinct values), and all (member, value)
    sorted. Claims with one version are dropped before anything is collected; what is left is as long as the group."""
    stated = claims.where(F.col(value).isNotNull())
    split = stated.groupBy(group, claim).agg(F.min(value).alias("__least"), F.max(value).alias("__most")).where("__least <> __most").select(group, claim)
    return stated.join(split, [group, claim]).groupBy(group, claim).agg(
        F.count_distinct(value).alias("versions"), F.sort_array(F.collect_list(F.struct(member, value))).alias("stated")
    )


def pair_scores(rows: DataFrame, group: str, label: str) -> DataFrame:
    """How well groups follow labels, counted over unordered pairs: same_label, merged, both.

    Pairs are counted from group sizes, never formed.
    """
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")
    counted = lambda *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(pairs, F.lit(0).cast("long")).alias("pairs"))
    return (
        counted(label).withColumnRenamed("pairs", "same_label")
        .crossJoin(counted(group).withColumnRenamed("pairs", "merged"))
        .crossJoin(counted(group, label).withColumnRenamed("pairs", "both"))
    )


def stage_counts(**stages: DataFrame) -> DataFrame:
    out = None
    for position, (name, rows) in enumerate(stages.items()):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(position).alias("position"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def roll_up(rows: DataFrame, sets: Sequence[Sequence[str]], **measures: Column) -> DataFrame:
    """Grouping sets: one aggregation with null in the columns that a set leaves out, and grouping_set (its position)."""
    names = list(dict.fromkeys(c for one in sets for c in one))
    columns = [F.col(c) for c in names]
    out = rows.groupingSets([[F.col(c) for c in one] for one in sets], *columns).agg(F.grouping_id(*columns).alias("__id"), *[c.alias(k) for k, c in measures.items()])
    number = F.lit(None).cast("int")
    for i, one in enumerate(sets):  # a bit is set for each column that the set leaves out
        number = F.when(F.col("__id") == sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in one), F.lit(i)).otherwise(number)
    return out.select(number.alias("grouping_set"), *names, *measures)


def ordinal(value: Column, order: Mapping[str, int] | Sequence[str]) -> Column:
    ranks = order if isinstance(order, Mapping) else {k: i for i, k in enumerate(order)}
    found = F.lit(None).cast("int")
    for k, i in ranks.items():
        found = F.when(value == k, F.lit(i)).otherwise(found)
    return found


def round_robin(rows: DataFrame, stratum: str, id_column: str) -> DataFrame:
    """turn: the place of a row in its stratum; ordered by (turn, stratum) the strata take turns."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(id_column)))


def within_budget(rows: DataFrame, group: str, order: str, size: Column, budget: int, most: int) -> DataFrame:
    """The leading rows of each group: at most `most`, and no more than the budget in all; the first always stays."""
    along = Window.partitionBy(group).orderBy(order)
    sized = rows.withColumn("running", F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(along))
    return sized.where((F.col("place") == 1) | ((F.col("place") <= most) & (F.col("running") <= budget)))
