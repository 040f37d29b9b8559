"""Joins, keep-first selection and per-key reductions used while assembling a source.

Right-hand sides are reduced to one row per key before they are joined, so no join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators.clean import MAX_CATEGORIES, category_values


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order`` (nulls last), remaining columns break ties.

    A minimum over structs combines on the map side, so a hot key never gathers its rows in one task
    the way a ranking window would.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    ranked = []
    for i, c in enumerate(c for c in order if c not in keys):
        ranked += [F.col(c).isNull().alias(f"null_{i}"), F.col(c).alias(f"by_{i}")]
    row = F.struct(*ranked, *[F.col(f"`{c}`") for c in rest])
    best = df.groupBy(*keys).agg(F.min(row).alias("_best"))
    return best.select(
        *[F.col(c) if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns]
    )


def left_lookup(df: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left equi-join; AQE broadcasts the dimension when its measured size is small enough."""
    return df.join(dimension, on, "left")


def reduce_reviews(reviews: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Score of the earliest review of each order."""
    undated = F.col("review_creation_date").isNull().alias("undated")
    first = F.min(F.struct(undated, "review_creation_date", "review_score")).getField("review_score")
    return reviews.groupBy(order_key).agg(first.alias("review_score"))


def most_common(
    df: DataFrame, keys: Sequence[str], column: str, fallback: str = "unknown"
) -> DataFrame:
    """Most frequent value per key, the smallest on ties, ``fallback`` when all are null."""
    counted = df.groupBy(*keys, column).agg(F.count(column).alias("_n"))
    best = F.min(
        F.when(
            F.col(column).isNotNull(),
            F.struct((-F.col("_n")).alias("rank"), F.col(column).alias("value")),
        )
    ).getField("value")
    return counted.groupBy(*keys).agg(F.coalesce(best, F.lit(fallback)).alias(column))


def reduce_payments(payments: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Per order: summed instalments and value, most common type, number of payments.

    Counting per (order, type) first feeds both the sums and the mode, in two map-side combined
    aggregates.
    """
    per_type = payments.groupBy(order_key, "payment_type").agg(
        F.sum("payment_installments").alias("_inst"),
        F.sum("payment_value").alias("_value"),
        F.count("payment_sequential").alias("_n"),
        F.count("payment_type").alias("_typed"),
    )
    best = F.min(
        F.when(
            F.col("payment_type").isNotNull(),
            F.struct((-F.col("_typed")).alias("rank"), F.col("payment_type").alias("value")),
        )
    ).getField("value")
    return per_type.groupBy(order_key).agg(
        F.coalesce(F.sum("_inst"), F.lit(0)).alias("payment_installments"),
        F.coalesce(F.sum("_value"), F.lit(0.0)).alias("payment_value"),
        F.coalesce(best, F.lit("unknown")).alias("payment_type"),
        F.sum("_n").alias("payment_sequential_count"),
    )


def reduce_items(items: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Per order: first product by item number, summed price and freight, item count."""
    first = F.min(F.struct("order_item_id", "product_id")).getField("product_id")
    return items.groupBy(order_key).agg(
        first.alias("product_id"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("price"),
        F.coalesce(F.sum("freight_value"), F.lit(0.0)).alias("freight_value"),
        F.count("order_item_id").alias("item_count"),
    )


def latest_properties(
    log: DataFrame, entity: str, name: str, value: str, time: str
) -> DataFrame:
    """Latest value per (entity, property); the larger value wins when times are equal."""
    latest = F.max(F.struct(F.col(time).alias("at"), F.col(value).alias("value"))).getField("value")
    return log.where(F.col(name).isNotNull()).groupBy(entity, name).agg(latest.alias(value))


def latest_properties_wide(
    log: DataFrame, entity: str, name: str, value: str, time: str,
    names: Sequence[str] | None = None, max_names: int = MAX_CATEGORIES,
) -> DataFrame:
    """One row per entity and one column per property, holding the latest value."""
    names = category_values(log, name, max_names) if names is None else list(names)
    narrow = latest_properties(log, entity, name, value, time)
    return narrow.groupBy(entity).agg(
        *[F.max(F.when(F.col(name) == F.lit(n), F.col(value))).alias(str(n)) for n in names]
    )


def semi(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(keys, on, "left_anti")


def with_min_activity(df: DataFrame, key: str, minimum: int, distinct: str | None = None) -> DataFrame:
    """Rows of keys with at least ``minimum`` rows (or distinct values of a column)."""
    measure = F.count(F.lit(1)) if distinct is None else F.count_distinct(distinct)
    active = df.groupBy(key).agg(measure.alias("_n")).where(F.col("_n") >= minimum).select(key)
    return semi(df, active, key)


def shared_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values present on both sides."""
    return a.select(column).intersect(b.select(column))


def values_missing(expected: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """Distinct expected values that were not found."""
    return expected.select(column).subtract(found.select(column))
