"""Clock arithmetic on TIMESTAMP_NTZ values in UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"
SECOND = "yyyy-MM-dd HH:mm:ss"


def naive(as_of: str | datetime) -> datetime:
    """A point in time as UTC wall-clock time; one without a zone, or text without one, is in UTC."""
    at = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return at if at.tzinfo is None else at.astimezone(timezone.utc).replace(tzinfo=None)


def moment(as_of: str | datetime) -> Column:
    """Literal point in time."""
    return F.lit(naive(as_of).isoformat(sep=" ")).cast("timestamp_ntz")


def up_to(ts: Column | str, as_of: str | datetime) -> Column:
    """Whether ``ts`` is not after ``as_of``; an event without a time isn't known to be.

    Written as a disjunction, which file formats can check against the bounds of their row groups.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.isNull() | (ts <= moment(as_of))


def dated(events: DataFrame, kind: str) -> DataFrame:
    """``events``, one without a time refused: it isn't known whether it came before a past moment."""
    refused = F.raise_error(F.lit(f"as_of lies in the past, but {kind} has no evt_block_time")).cast("boolean")
    return events.where(F.when(F.col("evt_block_time").isNull(), refused).otherwise(F.lit(True)))


def before(as_of: str | datetime, lookback: str) -> Column:
    """The moment ``lookback`` (for example ``1 day``) ahead of ``as_of``."""
    return moment(as_of) - F.expr(f"INTERVAL {lookback}")


def elapsed_days(ts: Column | str, as_of: str | datetime) -> Column:
    """Whole 24-hour days between ``ts`` and ``as_of`` (not calendar days)."""
    return F.timestamp_diff("DAY", ts, moment(as_of))


def utc(ts: Column) -> Column:
    """Zoned timestamp as UTC wall-clock time, counted from the epoch: local time may occur twice."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit("1970-01-01").cast("timestamp_ntz"))
