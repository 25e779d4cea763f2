"""Regions from names: the dictionary, whole and contained names, and one region out of several fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_key

#: Kinds of names, the most telling first.
KINDS = ("REGION", "CITY", "SYSTEM")
AMBIGUOUS = "AMBIGUOUS"
#: Characters and words that a name needs to count inside a longer value.
LEAST = 2


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def dictionary(names: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """key, kind, region_id: a name of several regions, or a listed one, is AMBIGUOUS; of several kinds the most telling counts.
    names: name, kind, region_id; ambiguous: name."""
    keyed = names.select(lookup_key(F.col("name")).alias("key"), "kind", "region_id")
    found = keyed.groupBy("key").agg(F.count_distinct("region_id").alias("n"), F.min("region_id").alias("region_id"), F.min_by("kind", _rank(F.col("kind"))).alias("kind"))
    listed = ambiguous.select(lookup_key(F.col("name")).alias("key"), F.lit(True).alias("listed")).distinct()
    clear = (F.col("n") == 1) & F.col("listed").isNull()
    return found.join(listed, "key", "full_outer").select("key", F.when(clear, F.col("kind")).otherwise(AMBIGUOUS).alias("kind"), F.when(clear, F.col("region_id")).alias("region_id"))


def whole(rows: DataFrame, value: str, names: DataFrame) -> DataFrame:
    """rows with kind and region_id of their whole value, null where it is no name."""
    return rows.join(names.select(F.col("key").alias("__key"), "kind", "region_id"), lookup_key(F.col(value)) == F.col("__key"), "left").drop("__key")


def _word_runs(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def _character_runs(value: Column, n: int) -> Column:
    return F.when(F.length(value) >= n, F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda i: F.substring(value, i, F.lit(n))))


def _sized(runs: Column, n: int) -> Column:
    return F.transform(runs, lambda x: F.struct(F.lit(n).alias("__words"), x.alias("__shape")))


def contained(rows: DataFrame, row_id: str, value: str, names: DataFrame) -> DataFrame:
    """row_id, kind, region_id from the names inside a longer value: AMBIGUOUS if they disagree.

    Ambiguous names don't count. Names in ASCII are whole words: a value shows its runs of as many words as
    names have. Other names may stand anywhere: a value shows its runs of as many characters. So values
    and names meet by equality, the runs of all lengths in one pass over the values.
    """
    clear = names.where((F.col("kind") != AMBIGUOUS) & (F.length("key") >= LEAST))
    ascii_ = F.regexp_like("key", F.lit(r"^[\x00-\x7F]*$"))
    spaced = F.trim(F.regexp_replace("key", r"(\W)", " $1 "))  # each mark is a word of its own
    listed = clear.withColumn("__shape", F.when(ascii_, F.regexp_replace(spaced, r"\s+", " ")).otherwise(F.col("key"))).withColumn("__words", F.when(ascii_, F.size(F.split("__shape", " "))).otherwise(-F.length("key")))
    source = rows.select(row_id, lookup_key(F.col(value)).alias("__value"))
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace("__value", r"(\W)", " $1 "), r"\s+", " ")), " ")
    lengths = [n for (n,) in listed.select("__words").distinct().collect()]  # no more than the longest name has characters
    # a value shorter than a length has no runs of it
    runs = {n: _word_runs(tokens, n) if n > 0 else _character_runs(F.col("__value"), -n) for n in lengths}
    shapes = F.array(*[_sized(r, n) for n, r in runs.items()])
    if not lengths:
        return source.limit(0).select(row_id, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("region_id"))
    shown = source.select(row_id, "__value", F.explode(F.array_distinct(F.flatten(F.array_compact(shapes)))).alias("__run")).select(row_id, "__value", "__run.*")
    found = shown.join(listed.select("__words", "__shape", "key", "kind", "region_id"), ["__words", "__shape"]).where("key <> __value").select(row_id, "kind", "region_id")
    one = F.count_distinct("region_id") == 1
    return found.groupBy(row_id).agg(F.when(one, F.min_by("kind", _rank(F.col("kind")))).otherwise(AMBIGUOUS).alias("kind"), F.when(one, F.min("region_id")).alias("region_id"))


def looked_up(rows: DataFrame, row_id: str, value: str, names: DataFrame) -> DataFrame:
    """row_id, kind, region_id of a value: as a whole name, else by the names it contains."""
    first = whole(rows.select(row_id, value), value, names).select(row_id, "kind", "region_id")
    rest = contained(rows.join(first.where("kind is null").select(row_id), row_id, "left_semi"), row_id, value, names)
    return first.where("kind is not null").unionByName(rest)


def resolved(fields: DataFrame, row_id: str, names: DataFrame) -> DataFrame:
    """One region for each row out of its stated fields: row_id, region_id, basis, source_field, diagnostic.

    fields: row_id, field, position, value; blank values don't count. Fields that agree establish the region,
    as SOURCE_STATED if one names the region itself, else REFERENCE_MAPPED. Otherwise the diagnostic says why not.
    """
    stated = fields.where(F.trim("value") != "").withColumn("__id", F.struct(row_id, "position"))
    found = looked_up(stated, "__id", "value", names)
    rows = stated.join(found, "__id", "left")
    clear = F.col("kind").isNotNull() & (F.col("kind") != AMBIGUOUS)
    best = F.when(clear, F.struct((F.col("kind") != "REGION").alias("mapped"), "position", "field"))
    seen = rows.groupBy(row_id).agg(F.count_distinct(F.when(clear, F.col("region_id"))).alias("regions"), F.min(F.when(clear, F.col("region_id"))).alias("region"), F.min(best).alias("best"), F.max(F.coalesce(F.col("kind") == AMBIGUOUS, F.lit(False))).alias("unclear"))
    one = F.col("regions") == 1
    out = fields.select(row_id).distinct().join(seen, row_id, "left")
    return out.select(
        row_id, F.when(one, F.col("region")).alias("region_id"),
        F.when(F.col("regions").isNull(), "NOT_STATED").when(~one, "UNRESOLVED").when(F.col("best.mapped"), "REFERENCE_MAPPED").otherwise("SOURCE_STATED").alias("basis"),
        F.when(one, F.col("best.field")).alias("source_field"),
        F.when(F.col("regions") > 1, "CONFLICTING_REGIONS").when(one | F.col("regions").isNull(), "NONE").when(F.col("unclear"), "AMBIGUOUS_NAME").otherwise("UNRECOGNIZED_VALUE").alias("diagnostic"),
    )


def specific(rows: DataFrame, value: str, names: DataFrame, generic: DataFrame) -> DataFrame:
    """rows whose value is neither a generic term nor the name of a region or city. generic: name."""
    out = names.where("kind in ('REGION', 'CITY')").select("key").unionByName(generic.select(lookup_key(F.col("name")).alias("key"))).distinct()
    return rows.join(out, lookup_key(F.col(value)) == F.col("key"), "left_anti")
