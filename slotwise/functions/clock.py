"""Clock helpers. Every operator gets its moment as the argument `as_of`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(as_of: dt.datetime) -> Column:
    """`as_of` as a zone-free timestamp literal."""
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def clock_text(as_of: dt.datetime) -> str:
    """`HH:MM`; opening hours are stored and compared as such zero-padded text."""
    return as_of.strftime("%H:%M")


def week_day(as_of: dt.datetime, week_start: int = 1) -> int:
    """Day number 1-7. `week_start` is the ISO number of the day counted as 1 (1 = Monday)."""
    return (as_of.isoweekday() - week_start) % 7 + 1


def add_months(day: Column, months: Column) -> Column:
    """Calendar months later; the last day of a month stays the last day of a month."""
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def age_within(birthdate: Column, begin: Column, end: Column, as_of: dt.datetime) -> Column:
    """Half-open age band: begin <= age in years < end at `as_of`."""
    now = moment(as_of)
    reached = add_months(birthdate, begin * 12).cast("timestamp_ntz") <= now
    passed = add_months(birthdate, end * 12).cast("timestamp_ntz") <= now
    return reached & ~passed


def clock_text_of(stamp: Column) -> Column:
    """`HH:MM` of a timestamp column."""
    return F.date_format(stamp, "HH:mm")


def week_day_of(stamp: Column, week_start: int = 1) -> Column:
    """Day number 1-7 of a timestamp column, as `week_day`."""
    return F.pmod(F.weekday(stamp) + 1 - week_start, F.lit(7)) + 1


def day_text_of(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy.MM.dd")


def parse_day(text: Column) -> Column:
    """Date of `year.month.day`, where the month may have one digit or two."""
    return F.to_date(text, "yyyy.M.dd")


def later(stamp: Column, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """Exact calendar arithmetic in place of fractions of a day."""
    span = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))
    return stamp + span
