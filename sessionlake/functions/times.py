"""Clock arithmetic in whole units, the way boundaries are counted rather than elapsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def millis_between(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def iso_week(moment: Column) -> Column:
    """`2024-W03`; a row without a time is `undated` so that weeks still sum to the whole."""
    year = F.extract(F.lit("YEAROFWEEK"), moment).cast("string")
    week = F.lpad(F.weekofyear(moment).cast("string"), 2, "0")
    return F.coalesce(F.concat(year, F.lit("-W"), week), F.lit("undated"))


def within_days(moment: Column, as_of: str, days: int) -> Column:
    """Started in the `days` before `as_of`, that day included. An unknown start is outside."""
    day = F.to_date(F.lit(as_of))
    inside = (moment >= F.date_sub(day, days).cast("timestamp")) & (
        moment < F.date_add(day, 1).cast("timestamp")
    )
    return F.coalesce(inside, F.lit(False))


def shifted(moment: Column, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + F.lit(seconds * 1_000_000).cast("long"))
