"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Length in seconds of each granularity (fixed values; a month is 30 days).
GRANULARITY_SECONDS = {
    "minute": 60,
    "hour": 3_600,
    "day": 86_400,
    "week": 604_800,
    "month": 2_592_000,
}


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz``."""
    seconds = (ts - _epoch()).cast("interval second").cast("decimal(20,6)")
    return (seconds * MICROS).cast("bigint")


def from_micros(us: Column) -> Column:
    """The ``timestamp_ntz`` of microseconds since 1970-01-01."""
    return _epoch() + F.make_dt_interval(
        secs=(us.cast("decimal(20,0)") / F.lit(MICROS).cast("decimal(8,0)")).cast("decimal(18,6)")
    )


def event_time(ts: Column) -> Column:
    """The instant of a ``timestamp_ntz`` read as UTC; watermarks need that type."""
    return F.timestamp_micros(epoch_micros(ts))


def from_event_time(instant: Column) -> Column:
    return from_micros(F.unix_micros(instant))


def seconds_interval(seconds: int | float) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def tumbling_start(ts: Column, granularity: str) -> Column:
    """Start of the aligned bucket of ``ts``; buckets count from 1970-01-01."""
    return F.window(ts, f"{GRANULARITY_SECONDS[granularity]} seconds")["start"]
