"""Instants are TIMESTAMP under UTC; day arithmetic is exact on microseconds."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(column) -> Column:
    """Microseconds since the epoch."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def floor_days(later, earlier) -> Column:
    """Whole days between two instants, rounded toward minus infinity (-1 hour is -1 day)."""
    gap = micros(later) - micros(earlier)
    return ((gap - F.pmod(gap, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("long")


def elapsed_days(later, earlier) -> Column:
    """Whole days between two instants, never below zero."""
    return F.greatest(floor_days(later, earlier), F.lit(0).cast("long"))


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


def shift_days(column, days) -> Column:
    """Instant moved by a number of 24-hour days; ``days`` may be a column and fractional."""
    step = days if isinstance(days, Column) else F.lit(days)
    return F.timestamp_micros((micros(column) + F.round(step * F.lit(DAY_MICROS))).cast("long"))


def parse_instant(column, pattern: str | None = None) -> Column:
    """Text to instant; text that does not parse becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    if pattern is None:
        return F.try_to_timestamp(column)
    return F.try_to_timestamp(column, F.lit(pattern))


def instant_from_millis(column) -> Column:
    """Epoch milliseconds to instant; text that is not a whole number becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_millis(column.try_cast("bigint"))


def from_micros(value: int) -> datetime:
    """Driver-side instant for use as a literal."""
    return _EPOCH + timedelta(microseconds=int(value))


def nearest_micros(value: float) -> int:
    """Whole microseconds; halves go away from zero, as in SQL (Python's ``round`` takes the even one)."""
    whole = math.floor(abs(value) + 0.5)
    return whole if value >= 0 else -whole


def to_micros(value: datetime) -> int:
    """Inverse of :func:`from_micros`; naive input is taken as UTC."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return (value - _EPOCH) // timedelta(microseconds=1)


def plus_days(value: datetime, days: float) -> datetime:
    return value + timedelta(days=days)


def instant(value: datetime) -> Column:
    """Literal instant. Keeping the column side bare lets the filter reach the Parquet scan."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value)
