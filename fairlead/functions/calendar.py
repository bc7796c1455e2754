"""Calendar predicates, labels and durations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period(year: int, month: int | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Half-open bounds of a year, or of one month of it."""
    if month is None:
        return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)
    following = (year + 1, 1) if month == 12 else (year, month + 1)
    return dt.datetime(year, month, 1), dt.datetime(*following, 1)


def calendar_filter(df: DataFrame, ts: str, month: int | None = None, year: int | None = None,
                    months: list[int] | None = None) -> DataFrame:
    """Keep rows of a month, a year, a month of a year or a season; null times drop out.

    A given year becomes a time range, so file and row-group statistics can prune.
    """
    if year is not None:
        low, high = period(year, month)
        kind = dict(df.dtypes)[ts]
        bound = lambda value: F.lit(value.isoformat(sep=" ")).cast(kind)
        df = df.filter((F.col(ts) >= bound(low)) & (F.col(ts) < bound(high)))
    elif month is not None:
        df = df.filter(F.month(ts) == month)
    if months is not None:
        df = df.filter(F.month(ts).isin(months))
    return df


def weekday_is(ts, day: int) -> Column:
    """Monday is 0."""
    return F.weekday(_col(ts)) == day


def is_weekend(ts) -> Column:
    return F.weekday(_col(ts)) >= 5


def day_name(ts) -> Column:
    return F.date_format(_col(ts), "EEEE")


def month_name(ts, short: bool = False) -> Column:
    return F.date_format(_col(ts), "MMM" if short else "MMMM")


def year_month(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def micros(ts) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def minutes_between(start, end) -> Column:
    return seconds_between(start, end) / 60


def hours_between(start, end) -> Column:
    return seconds_between(start, end) / 3600


def local_time(ts_utc, zone: str = "CET") -> Column:
    """A UTC wall time as the wall time of ``zone``, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts_utc).cast("timestamp_ntz"))


def iso(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
