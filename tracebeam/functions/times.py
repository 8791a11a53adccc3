"""Time expressions. Every "now" is an explicit argument so that results can be repeated."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative-window suffixes and their length in seconds.
WINDOW_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def instant(value: datetime | str | Column) -> Column:
    """A timestamp column from a literal or a column."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def seconds_of(interval: str | float | timedelta) -> float:
    """Length in seconds of a number, a timedelta or text such as ``6 hours`` / ``30m``."""
    if isinstance(interval, timedelta):
        return interval.total_seconds()
    if isinstance(interval, (int, float)):
        return float(interval)
    number, unit = re.fullmatch(r"\s*([0-9.]+)\s*([a-zA-Z]+)\s*", interval).groups()
    if unit.lower().startswith("s"):
        return float(number)
    return float(number) * WINDOW_UNITS[unit.lower()[0]]


def shift(col: Column, seconds: float) -> Column:
    """``col`` moved by a number of seconds, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(col) + F.lit(round(seconds * 1_000_000)))


def seconds_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def parse_iso(col: Column) -> Column:
    """ISO-8601 text (``Z``, ``+00:00`` and ``+0000`` suffixes) to timestamp; bad text is null."""
    text = F.regexp_replace(F.trim(col), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso_date = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    return F.when(text.rlike(iso_date), F.try_to_timestamp(text))


def between_times(
    df: DataFrame,
    at: str,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
) -> DataFrame:
    """Rows with ``since <= at <= until``; an absent bound is open, a null time never passes."""
    out = df.where(F.col(at).isNotNull())
    if since is not None:
        out = out.where(F.col(at) >= instant(since))
    if until is not None:
        out = out.where(F.col(at) <= instant(until))
    return out


def trailing(df: DataFrame, at: str, days: int, as_of: datetime | str) -> DataFrame:
    """Rows of the last ``days`` days counted back from ``as_of``."""
    return df.where(F.col(at) >= shift(instant(as_of), -days * 86400))


def relative_since(text: Column, as_of: datetime | str | Column) -> Column:
    """``2h``, ``1d``, ``30m``, ``1w`` counted back from ``as_of``; anything else is null."""
    clean = F.lower(F.trim(text))
    pattern = r"^([+-]?[0-9]{1,9})([mhdw])$"
    number = F.regexp_extract(clean, pattern, 1)
    unit = F.regexp_extract(clean, pattern, 2)
    length = F.coalesce(
        *[F.when(unit == name, F.lit(seconds)) for name, seconds in WINDOW_UNITS.items()]
    )
    micros = number.try_cast("bigint") * length * F.lit(1_000_000)
    return F.when(
        clean.rlike(pattern), F.timestamp_micros(F.unix_micros(instant(as_of)) - micros)
    )


def short_delta(seconds: Column) -> Column:
    """``42s``, ``7.0min`` or ``1.50h``."""
    return (
        F.when(seconds < 60, F.format_string("%.0fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fmin", seconds / 60))
        .otherwise(F.format_string("%.2fh", seconds / 3600))
    )


def clock_text(at: Column) -> Column:
    """Event time to the second; ``?`` when unknown."""
    return F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("?"))
