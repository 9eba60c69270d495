"""Times as microseconds since 1970 UTC (long columns), timeframes, civil days and Easter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
DAY = MICROS["d"]
HOUR = MICROS["h"]


def micros(ts: Column) -> Column:
    """A timestamp, with or without zone, as microseconds."""
    return F.unix_micros(ts.cast("timestamp"))


def timestamp(us: Column) -> Column:
    return F.timestamp_micros(us)


def from_millis(ms: Column) -> Column:
    return ms * 1_000


def to_millis(us: Column) -> Column:
    return bucket(us, 1_000)


def from_iso(text: Column) -> Column:
    return F.unix_micros(F.to_timestamp(text))


def to_iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_index(us: Column) -> Column:
    """Whole UTC days since 1970."""
    return bucket(us, DAY)


def bucket(us: Column, size: int) -> Column:
    """Number of the bucket of that size, counted from 1970."""
    return F.call_function("div", us - F.pmod(us, F.lit(size)), F.lit(size))


def parse_timeframe(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text.strip())
    if not m or int(m[1]) == 0:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(m[1]) * MICROS[m[2]]


def format_timeframe(us: int) -> str:
    for unit in ("d", "h", "m", "s", "ms"):
        if us % MICROS[unit] == 0:
            return f"{us // MICROS[unit]}{unit}"
    raise ValueError(f"not whole milliseconds: {us}")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the century's corrections of the moon's age."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    golden, century = year % 19, div(year, 100)
    epact = F.pmod(century - div(century, 4) - div(century * 8 + 13, 25) + golden * 19 + 15, F.lit(30))
    # The two latest full moons come a day earlier, so that a cycle has no date twice.
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    weekday = F.pmod(year + div(year, 4) + moon + 2 - century + div(century, 4), F.lit(7))
    days = moon - weekday
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), days.cast("int"))


def weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1
