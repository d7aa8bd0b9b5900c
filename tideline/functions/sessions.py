"""Session phases and calendar-anchored buckets on microseconds since the epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Phase starts in seconds of the local day: pre-open, auction, live, closing, closed.
DEFAULT_PHASES = (32400, 32880, 33300, 55800, 56400)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def local_time(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts.cast("timestamp"), zone)


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(local_time(ts, zone))


def second_of_day(local: Column) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def instant(date: Column, seconds: Column, zone: str) -> Column:
    """Microseconds of a local date and second of the day, by the zone's own rules on that date."""
    midnight = date.cast("timestamp")
    return F.unix_micros(F.to_utc_timestamp(midnight + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), zone))


def is_trading_day(explicit_open: Column, weekend: Column, explicit_closed: Column) -> Column:
    """An explicit open session wins over the weekend, the weekend over all else."""
    return F.when(explicit_open, True).when(weekend, False).otherwise(~explicit_closed)


def phase(seconds: Column, phases: Sequence[int] = DEFAULT_PHASES) -> Column:
    """The half-open phase that a second of the day lies in."""
    pre, auction, live, closing, closed = phases
    return (
        F.when((seconds >= pre) & (seconds < auction), "PRE_OPEN")
        .when((seconds >= auction) & (seconds < live), "OPENING_AUCTION")
        .when((seconds >= live) & (seconds < closing), "LIVE_SESSION")
        .when((seconds >= closing) & (seconds < closed), "CLOSING_SESSION")
        .otherwise("MARKET_CLOSED")
    )


def market_state(covered: Column, trading: Column, halted: Column, seconds: Column, phases: Sequence[int] = DEFAULT_PHASES) -> Column:
    """Coverage, then holiday, then halt, then the time of day."""
    return (
        F.when(~covered, "CALENDAR_UNAVAILABLE").when(~trading, "HOLIDAY").when(halted, "EMERGENCY_HALT").otherwise(phase(seconds, phases))
    )


def bucket_index(us: Column, open_us: Column, seconds: Column | int) -> Column:
    """Which bucket of so many seconds an instant lies in, counted from the session's open."""
    width = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * SECOND
    return F.floor((us - open_us) / width).cast("long")


def bucket_start(index: Column, open_us: Column, seconds: Column | int) -> Column:
    width = (F.lit(seconds) if isinstance(seconds, int) else seconds).cast("long") * SECOND
    return open_us + index * width


def bucket_end(index: Column, open_us: Column, close_us: Column, seconds: Column | int) -> Column:
    """The last bucket ends with the session."""
    return F.least(bucket_start(index + 1, open_us, seconds), close_us)
