"""Null-safe scalars: coercion, lookups, guarded division, clipping, stable hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hexadecimal digits of an MD5 digest: 60 bits, always a positive BIGINT.
HASH_DIGITS = 15
HASH_SPAN = float(16**HASH_DIGITS)


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(column, default: float | None = 0.0) -> Column:
    """Text or number to double; anything unreadable becomes ``default``."""
    number = as_column(column).try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def trimmed(column) -> Column:
    return F.trim(as_column(column).cast("string"))


def lookup(column, mapping: Mapping, default) -> Column:
    """Dictionary lookup with a default for missing keys and nulls."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(column)), F.lit(default))


def ratio(top, bottom, default: float | None = 0.0) -> Column:
    """Division that yields ``default`` (or null) when the divisor is zero or null."""
    value = F.try_divide(as_column(top).cast("double"), as_column(bottom).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def imbalance(negatives, positives) -> Column:
    """Negatives per positive, infinite without positives."""
    return F.coalesce(ratio(negatives, positives, None), F.lit(float("inf")))


def clip_upper(column, cap) -> Column:
    """Upper clip that leaves nulls alone (``least`` would return the cap for them)."""
    column = as_column(column)
    return F.when(column > F.lit(cap), F.lit(cap)).otherwise(column)


def clip_lower(column, floor) -> Column:
    column = as_column(column)
    return F.when(column < F.lit(floor), F.lit(floor)).otherwise(column)


def half_even(column, digits: int = 0) -> Column:
    """Banker's rounding."""
    return F.bround(as_column(column), digits)


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows for which ``condition`` holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    """Aggregate: number of rows for which ``condition`` holds, as BIGINT."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def edges_passed(column, edges: Sequence[float], inclusive: bool) -> Column:
    """How many edges lie at or below (``inclusive``) or strictly below the value."""
    column = as_column(column)
    hits = [F.when(column >= e if inclusive else column > e, 1).otherwise(0) for e in edges]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def stable_hash(columns: Sequence, seed: int, salt: str = "") -> Column:
    """Deterministic 60-bit number from column values; the same on any engine with MD5.

    Random choices order by it instead of ``rand()``, so they do not depend on partitioning and
    survive task retries.
    """
    parts = [as_column(c).cast("string") for c in columns]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(f"{salt}{seed}")))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")


def stable_uniform(columns: Sequence, seed: int, salt: str = "") -> Column:
    """:func:`stable_hash` scaled to [0, 1)."""
    return stable_hash(columns, seed, salt) / F.lit(HASH_SPAN)
