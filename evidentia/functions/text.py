"""Text expressions: normal forms, occurrences, escapes, tokens and term groups."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def lookup_key(text: Column) -> Column:
    return F.lower(collapse(text))


def clip(text: Column, limit: int) -> Column:
    """Collapsed text of at most limit characters, cut with an ellipsis."""
    short = collapse(text)
    return F.when(F.length(short) <= limit, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, limit - 1)), F.lit("…")))


def word_count(text: Column) -> Column:
    """Words, not counting parentheses."""
    bare = F.trim(F.translate(text, "()", "  "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"\s+")))


def occurrence_count(text: Column, needle: str) -> Column:
    """How often the needle occurs, overlapping occurrences too."""
    return F.size(F.split(text, "(?=" + re.escape(needle) + ")")) - 1 + text.startswith(needle).cast("int")


def occurrences(text: Column, needle: str) -> Column:
    """0-based offsets of all occurrences, overlapping ones too, of short texts such as labels and focus passages."""
    pieces = F.split(text, "(?=" + re.escape(needle) + ")")
    starts = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
    )["all"]
    pairs = F.zip_with(pieces, starts, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    return F.transform(F.filter(pairs, lambda x, i: (i > 0) | text.startswith(needle)), lambda x: x["s"])


def same_label_spans(text: Column, label: str) -> Column:
    """array<struct<start, end>> of a label in any case, also where occurrences overlap; none in a text whose length changes in lower case."""
    low = F.lower(text)
    starts = F.when(F.length(low) == F.length(text), occurrences(low, label.lower())).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + len(label)).alias("end")))


def mixed_script_words(text: Column) -> Column:
    """Words that hold both Hangul and Han characters."""
    words = F.regexp_extract_all(text, F.lit(r"([\uac00-\ud7af\u4e00-\u9fff]+)"), 1)
    return F.filter(words, lambda w: F.regexp_like(w, F.lit(r"[\uac00-\ud7af]")) & F.regexp_like(w, F.lit(r"[\u4e00-\u9fff]")))


def escape_link(text: Column) -> Column:
    """Text inside the brackets of a Markdown link."""
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def safe_token(value: Column, vocabulary: tuple[str, ...] = (), most: int = 96) -> Column:
    """value where it is a short plain token (of the vocabulary, if one is given), else UNKNOWN; null stays null."""
    plain = F.regexp_like(value, F.lit(rf"^[A-Za-z0-9_.:/-]{{1,{most}}}$"))
    good = plain & value.isin(*vocabulary) if vocabulary else plain
    return F.when(value.isNotNull(), F.when(good, value).otherwise("UNKNOWN"))


def places_listed(text: Column) -> Column:
    """The names in a list of places."""
    parts = F.split(text, r"\s*(?:[,&/、，與和及]|\band\b)\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def all_generic(places: Column, generic: Column) -> Column:
    """Whether a list of places names nothing but general terms (an array in lower case); a list without places does not."""
    return (F.size(places) > 0) & F.forall(places, lambda p: F.array_contains(generic, F.lower(p)))


def highlights(sentences: Column, most: int = 2) -> Column:
    """The first sentences of an array."""
    return F.slice(F.coalesce(sentences, F.array().cast("array<string>")), 1, most)


def stated_facts(claims: Column | None = None, **facts: Column) -> Column:
    """map of the facts that aren't blank, as they stand, with source_claims (JSON of a map, by key) if there are claims."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in facts.items()])
    stated = F.filter(pairs, lambda p: F.trim(F.coalesce(p["value"], F.lit(""))) != "")
    if claims is not None:
        entry = F.struct(F.lit("source_claims").alias("key"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(claims)))).alias("value"))
        stated = F.concat(stated, F.when(F.coalesce(F.size(claims), F.lit(0)) > 0, F.array(entry)).otherwise(F.filter(F.array(entry), lambda e: F.lit(False))))
    return F.map_from_entries(stated)


def period_display(start: Column, end: Column) -> Column:
    """A period as readers see it: the year once where both ends share it."""
    full = F.date_format(start, "yyyy/MM/dd")
    return F.concat(full, F.lit(" - "), F.when(F.year(start) == F.year(end), F.date_format(end, "MM/dd")).otherwise(F.date_format(end, "yyyy/MM/dd")))


def subject(title: str, period: Column, report_id: Column, events: Column) -> Column:
    """Subject of a report: title, period (the report's id without one) and number of events."""
    named = F.coalesce(F.nullif(F.trim(period), F.lit("")), report_id)
    return F.concat_ws("｜", F.lit(title), named, F.concat(events.cast("string"), F.lit(" 則")))


def file_names(kind: str, end: Column) -> Column:
    """struct of the file names of a period's debug file and summary."""
    day = F.date_format(end, "yyyy-MM-dd")
    return F.struct(*[F.concat(F.lit(f"{name}_{kind}_"), day, F.lit(".json")).alias(name) for name in ("developer_debug", "engineering_summary")])


def or_group(terms: Column, prefix: str = "") -> Column:
    """(a OR "b c"): terms of several words are quoted, others get the prefix."""
    shown = F.transform(terms, lambda t: F.when(F.regexp_like(t, F.lit(r"\s")), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit(prefix), t)))
    return F.concat(F.lit("("), F.array_join(shown, " OR "), F.lit(")"))


def packed_terms(terms: Column, room: int) -> Column:
    """array<array<string>>: terms in order, as few groups as fit; a group's words and the ORs between its terms
    are no more than room. A term that is longer than that alone is a group of its own."""
    words = lambda t: F.size(F.split(F.trim(t), r"\s+"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("used"))

    def step(at, t):
        fits = (F.size(at["open"]) == 0) | (at["used"] + 1 + words(t) <= room)
        return F.struct(
            F.when(fits, at["done"]).otherwise(F.array_append(at["done"], at["open"])).alias("done"),
            F.when(fits, F.array_append(at["open"], t)).otherwise(F.array(t)).alias("open"),
            F.when(fits & (F.size(at["open"]) > 0), at["used"] + 1 + words(t)).otherwise(words(t)).alias("used"),
        )

    return F.aggregate(terms, zero, step, lambda at: F.when(F.size(at["open"]) > 0, F.array_append(at["done"], at["open"])).otherwise(at["done"]))


def filled(template: Column, **values: Column) -> Column:
    """The template with {name} replaced; white space collapsed."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return collapse(out)
