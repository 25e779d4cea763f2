"""Date expressions: calendar dates without zone conversion, reporting periods and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the latency buckets in milliseconds.
LATENCY = (10, 50, 100, 250, 500, 1000, 5000, 10_000)
#: Fixed value: the zone whose calendar weeks are reported.
ZONE = "Asia/Taipei"


def calendar_date(raw: Column) -> Column:
    """The date a text states, in its own zone: ISO date, or ISO date and time with any offset or [Zone]; else null."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?(\[[A-Za-z_/+-]+\])?)?$"
    return F.when(F.regexp_like(raw, F.lit(shape)), F.substring(raw, 1, 10).try_cast("date"))


def mail_instant(raw: Column) -> Column:
    """The instant of a date in mail format, with or without weekday; null for anything else."""
    bare = F.regexp_replace(raw, r"^[A-Za-z]+,\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))


def week_start(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def previous_week(now: Column) -> Column:
    """struct<start, end> of the last complete week, Monday to Sunday, in the reporting zone."""
    day = F.to_date(F.from_utc_timestamp(now, ZONE))
    start = F.date_sub(week_start(day), 7)
    return F.struct(start.alias("start"), F.date_add(start, 6).alias("end"))


def month_of_week(start: Column, end: Column) -> Column:
    """struct<start, end> of the month whose last day is in the week; null if none is."""
    last = F.last_day(start)
    return F.when(last <= end, F.struct(F.trunc(start, "MM").alias("start"), last.alias("end")))


def in_window(day: Column, start: Column, end: Column, slack: int = 1) -> Column:
    """Within the window and some days around it; a missing date stays in."""
    return day.isNull() | day.between(F.date_sub(start, slack), F.date_add(end, slack))


def latency_bucket(value: Column, bounds: Sequence[int] = LATENCY) -> Column:
    """Name of the range of whole milliseconds a value is in; null for anything but a whole number from 0 on."""
    found = F.lit(f"{bounds[-1]}ms+")
    for low, high in reversed(list(zip((0, *bounds), bounds))):
        found = F.when(value < high, f"{low}-{high - 1}ms").otherwise(found)
    return F.when((value >= 0) & (value == F.floor(value)), found)


def hop_bucket(value: Column, most: int = 20) -> Column:
    """The number of hops up to most, then most+; null for anything but a whole number from 0 on."""
    whole = F.when((value >= 0) & (value == F.floor(value)), value.cast("long"))
    return F.when(whole <= most, whole.cast("string")).when(whole > most, f"{most}+")


def hours_since(since: Column, now: Column) -> Column:
    """Whole hours between two instants."""
    return F.timestamp_diff("HOUR", since, now)


def valid_period(start: Column, end: Column) -> Column:
    return F.coalesce(start <= end, F.lit(False))


def zone_of(raw: Column) -> Column:
    """The offset or [Zone] that a date text ends in, else null."""
    return F.nullif(F.regexp_extract(raw, r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s?(Z|[+-]\d{2}:?\d{2}|\[[A-Za-z_/+-]+\])", 1), F.lit(""))
