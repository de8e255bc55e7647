"""Dates and times: parts, truncation, differences, formats; plain expressions over timestamps with or without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(ts: Column) -> Column:
    """Year, quarter, month, day, ISO weekday (Monday 1), hour, minute and second as a struct of ints."""
    return F.struct(
        F.year(ts).alias("year"), F.quarter(ts).alias("quarter"), F.month(ts).alias("month"), F.dayofmonth(ts).alias("day"), (F.weekday(ts) + 1).alias("weekday"),
        F.hour(ts).alias("hour"), F.minute(ts).alias("minute"), F.second(ts).alias("second"),
    )


def floor_to(ts: Column, unit: str) -> Column:
    """Begin of the unit (year, month, week, day, hour, minute) that a time falls into."""
    return F.date_trunc(unit, ts)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from the date of a to that of b."""
    return F.datediff(b, a)


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def parsed(text: Column, *formats: str) -> Column:
    """A time read by the first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def shown(ts: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(ts, pattern)
