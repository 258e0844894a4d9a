"""Time buckets, named by the UTC instant they start at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
UNITS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
SINGLE = "single"
EPOCH = "1970-01-01T00:00:00Z"


def parse(name: str) -> str | None:
    """The interval of a name, in any case; None if there is none."""
    n = name.lower()
    return n if n in UNITS or n == SINGLE else None


def _iso(ts: Column) -> Column:
    return F.date_format(ts, ISO)


def start(interval: str, ts: Column, offset: int = 0) -> Column:
    """ISO start of the bucket that ts lies in, moved by offset buckets; single ignores both.  The session's time zone is UTC."""
    if interval == SINGLE:
        return F.lit(EPOCH)
    unit = UNITS[interval]
    at = F.date_trunc(unit, ts.cast("timestamp"))
    return _iso(F.timestamp_add(unit.upper(), F.lit(offset), at) if offset else at)


def fixed_start(ms: int, ts: Column, offset: int = 0) -> Column:
    """ISO start of buckets of ms milliseconds counted from the epoch, rounded towards it."""
    n = F.unix_millis(ts.cast("timestamp"))
    return _iso(F.timestamp_millis((n - n % ms) + F.lit(offset * ms)))


def instant(name: Column) -> Column:
    """The timestamp that an ISO start names."""
    return F.to_timestamp(name, ISO)


def shift(interval: str, name: Column, offset: int) -> Column:
    """The start of the bucket offset buckets from a named one."""
    return start(interval, instant(name), offset)
