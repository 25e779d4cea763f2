"""Vocabularies that stand in Markdown documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A term that stands for a list which is kept elsewhere; it must be a group's only term.
LISTED = "{MONITORED_STANDARDS}"


def section(text: Column, start: str, end: str) -> Column:
    """What stands between the first line start and the next line end; the whole text where there is no start."""
    rest = F.when(F.contains(text, F.lit(start)), F.substr(text, F.instr(text, start) + len(start))).otherwise(text)
    return F.substring_index(rest, end, 1)


def vocabulary(documents: DataFrame, start: str, end: str, listed: Sequence[str] = ()) -> DataFrame:
    """Terms of the vocabulary section: document_id, profile, intent, group, position (from 0), term, broken.

    documents: document_id, text. A heading ### `profile` — opens a profile, a line * `intent`: group = a, b;
    group = c. gives its groups. A repeated intent of a profile counts as its last line says. The term LISTED
    stands for the list given. A group with an empty term, or with LISTED beside other terms, is broken and
    comes as one row without a term; so does an intent without groups (group null).
    """
    lines = documents.select("document_id", F.posexplode(F.split(section(F.col("text"), start, end), r"\r\n|[\r\n]")).alias("line_no", "line"))
    heading = F.regexp_extract("line", "^### `([^`]+)` —", 1)
    above = Window.partitionBy("document_id").orderBy("line_no")
    placed = lines.withColumn("profile", F.last(F.when(heading != "", heading), ignorenulls=True).over(above)).where("profile is not null")
    intent, body = (F.regexp_extract("line", r"^\* `([^`]+)`: (.+)$", k) for k in (1, 2))
    entries = placed.select("document_id", "profile", "line_no", intent.alias("intent"), body.alias("body")).where("intent <> ''")
    entries = entries.groupBy("document_id", "profile", "intent").agg(F.max_by("body", "line_no").alias("body"))

    bare = lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"\.+$", ""), r"^[\s`]+|[\s`]+$", "")
    parts = F.filter(F.transform(F.split("body", ";"), bare), lambda s: F.contains(s, F.lit("=")))
    groups = entries.select("document_id", "profile", "intent", F.posexplode_outer(parts).alias("place", "part"))
    name = F.trim(F.substring_index("part", "=", 1))
    terms = F.transform(F.split(F.substr("part", F.instr("part", "=") + 1), ","), lambda t: F.trim(t))
    groups = groups.select("document_id", "profile", "intent", "place", name.alias("group"), terms.alias("terms"))
    groups = groups.groupBy("document_id", "profile", "intent", "group").agg(F.max_by("terms", "place").alias("terms"))
    beside = F.array_contains("terms", LISTED) & (F.size("terms") > 1)
    broken = F.col("group").isNull() | F.exists("terms", lambda t: t == "") | beside
    full = F.when(broken, F.array().cast("array<string>")).when(F.array_contains("terms", LISTED), F.array(*[F.lit(x) for x in listed]).cast("array<string>")).otherwise(F.col("terms"))
    found = groups.select("document_id", "profile", "intent", "group", broken.alias("broken"), F.posexplode_outer(full).alias("position", "term"))
    return found.select("document_id", "profile", "intent", "group", "position", "term", "broken")


def incomplete_profiles(terms: DataFrame, intents: Sequence[str]) -> DataFrame:
    """Profiles of a vocabulary whose intents are not exactly those that are due: document_id, profile."""
    due = F.sort_array(F.array(*[F.lit(i) for i in intents]))
    return terms.groupBy("document_id", "profile").agg(F.sort_array(F.collect_set("intent")).alias("has")).where(F.col("has") != due).select("document_id", "profile")
