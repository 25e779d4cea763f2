"""Dictionary lookup of names inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a short name by which it meets texts.
SEED = 4


def _runs(text: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def contained(rows: DataFrame, row_id: str, text: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """(row_id, name_id) for each name that a text contains.

    A word of a name that has a space on both sides is a whole word of every text that contains the
    name. Texts and names meet on the longest such word, and the whole name is compared then. Names
    without such a word (one or two words) meet the texts on their first characters: each text shows its
    distinct runs of as many characters. Both are equalities, so nothing is compared with everything.
    """
    words = F.split(name, " ")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    seeded = names.where(F.length(name) > 0).select(name_id, F.col(name).alias("__name"), longest.alias("__word"))
    source = rows.select(row_id, F.col(text).alias("__text"))
    places = source.select(row_id, "__text", F.explode(F.array_distinct(F.split("__text", " "))).alias("__word"))
    found = places.join(seeded.where("__word is not null"), "__word").where(F.contains("__text", "__name")).select(row_id, name_id)
    short = seeded.where("__word is null").withColumn("__n", F.least(F.length("__name"), F.lit(SEED))).withColumn("__seed", F.substring(F.col("__name"), F.lit(1), F.col("__n")))
    for n in [r[0] for r in short.select("__n").distinct().collect()]:  # at most SEED numbers
        shown = source.where(F.length("__text") >= n).select(row_id, "__text", F.explode(F.array_distinct(_runs(F.col("__text"), n))).alias("__seed"))
        met = shown.join(short.where(F.col("__n") == n).select(name_id, "__name", "__seed"), "__seed")
        found = found.unionByName(met.where(F.contains("__text", "__name")).select(row_id, name_id))
    return found
