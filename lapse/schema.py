"""The standard event table: ten known columns, two required, extra columns pass through."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOMER = "customer_id"
TIME = "event_time"

STANDARD_TYPES = {
    CUSTOMER: None,  # kept as in the source
    TIME: T.TimestampType(),
    "transaction_value": T.DoubleType(),
    "event_type": T.StringType(),
    "product_id": None,
    "review_score": T.DoubleType(),
    "payment_type": T.StringType(),
    "delivery_delay": T.DoubleType(),
    "engagement_signal": T.DoubleType(),
    "session_id": T.StringType(),
}
STANDARD_COLUMNS = tuple(STANDARD_TYPES)
REQUIRED_COLUMNS = (CUSTOMER, TIME)

# Columns a feature group needs before it can run.
GROUP_REQUIREMENTS = {
    "purchase": (CUSTOMER, TIME),
    "monetary": (CUSTOMER, TIME, "transaction_value"),
    "inactivity": (CUSTOMER, TIME),
    "review": (CUSTOMER, "review_score"),
    "delivery": (CUSTOMER, "delivery_delay"),
    "payment": (CUSTOMER, "payment_type"),
    "engagement": (CUSTOMER, "event_type"),
    "cadence": (CUSTOMER, TIME),
}
GROUPS = tuple(GROUP_REQUIREMENTS)


class SchemaError(ValueError):
    """A required column is missing or unusable."""


def missing_columns(df: DataFrame, expected: Iterable[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in expected if c not in present]


def require_columns(df: DataFrame, expected: Iterable[str], name: str = "frame") -> DataFrame:
    missing = missing_columns(df, expected)
    if missing:
        raise SchemaError(f"{name}: missing columns {missing}")
    return df


def conform(df: DataFrame) -> DataFrame:
    """Cast the known columns to the standard types; everything else stays as it is."""
    require_columns(df, REQUIRED_COLUMNS, "standard events")
    casts = {
        name: F.col(name).cast(kind)
        for name, kind in STANDARD_TYPES.items()
        if kind is not None and name in df.columns and df.schema[name].dataType != kind
    }
    return df.withColumns(casts) if casts else df


def available_groups(df: DataFrame, wanted: Iterable[str] | None = None) -> list[str]:
    """Feature groups whose required columns exist, in canonical order; unknown names drop out."""
    asked = GROUPS if wanted is None else [g for g in wanted if g in GROUP_REQUIREMENTS]
    return [g for g in asked if not missing_columns(df, GROUP_REQUIREMENTS[g])]
