"""Row filters, coercions, imputation and encodings applied before standardisation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse import settings
from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators.order_stats import exact_quantiles
from lapse.operators.rank_search import column_quantiles
from lapse.schema import CUSTOMER, TIME

# Encodings become one column (or one literal) per value; beyond this the column is an identifier.
MAX_CATEGORIES = 10_000


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=[c for c in columns if c in df.columns])


def dropped_rows(before: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of rows :func:`drop_missing` keeps and drops."""
    present = [F.col(c).isNotNull() for c in columns if c in before.columns]
    complete = present[0]
    for test in present[1:]:
        complete = complete & test
    return before.agg(
        S.count_where(complete).alias("kept"), S.count_where(~complete).alias("dropped")
    )


def within_time(df: DataFrame, column: str, low: datetime, high: datetime) -> DataFrame:
    """Both ends inclusive; the literals reach the scan."""
    return df.where(F.col(column).between(tm.instant(low), tm.instant(high)))


def at_least(df: DataFrame, column: str, bound: float = 0.0, strict: bool = False) -> DataFrame:
    """Keep values at or above the bound (above, when strict); nulls drop out."""
    value = F.col(column)
    return df.where(value > F.lit(bound) if strict else value >= F.lit(bound))


def quantile_cap(df: DataFrame, column: str, q: float = settings.OUTLIER_QUANTILE) -> float | None:
    """The cap, or None when it would not be positive."""
    cap = exact_quantiles(df, column, [q])[0]
    return cap if cap is not None and cap > 0 else None


def cap_at_quantile(
    df: DataFrame, column: str, q: float = settings.OUTLIER_QUANTILE,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Clip large values at an exact quantile.

    By default the quantile is taken over all rows, as the workflow always did; pass the rows before
    the cutoff as ``fit_on`` to keep later rows out of the cap.
    """
    cap = quantile_cap(df if fit_on is None else fit_on, column, q)
    return df if cap is None else df.withColumn(column, S.clip_upper(column, cap))


def cap_all_at_quantile(df: DataFrame, columns: Sequence[str], q: float = settings.OUTLIER_QUANTILE) -> DataFrame:
    """``cap_at_quantile`` for several columns, whose caps are found in one search."""
    caps = column_quantiles(df, [F.col(f"`{c}`") for c in columns], [q]) if columns else []
    return df.withColumns({c: S.clip_upper(c, cap) for c, (cap,) in zip(columns, caps) if cap is not None and cap > 0})


def fill_median(
    df: DataFrame, column: str, fallback: float = 5.0, fit_on: DataFrame | None = None
) -> DataFrame:
    """Replace nulls by the exact median, or by ``fallback`` when there is none."""
    median = exact_quantiles(df if fit_on is None else fit_on, column, [0.5])[0]
    value = fallback if median is None else median
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(float(value))))


def fill_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.na.fill(0, subset=present) if present else df


def drop_prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Drop rows whose trimmed text starts with the prefix (cancelled invoices)."""
    text = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("nan")))
    return df.withColumn(column, text).where(~F.col(column).startswith(prefix))


def coerce_number(df: DataFrame, column: str, default: float = 0.0) -> DataFrame:
    return df.withColumn(column, S.to_number(column, default))


def clean_id(df: DataFrame, column: str) -> DataFrame:
    """Trim an identifier and drop null or blank ones."""
    return df.withColumn(column, S.trimmed(column)).where(F.col(column) != "")


def label_from_text(column: str, positive: str) -> Column:
    """1 for the positive text, 0 for anything else including null."""
    return F.when(F.col(column) == positive, 1).otherwise(0)


# ---------------------------------------------------------------------------- categoricals


def category_values(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values of a categorical column, checked to be few."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1)
    values = sorted(row[0] for row in found.collect())
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; it is not categorical")
    return values


def category_code(column: str, values: Sequence) -> Column:
    """Position of the value in sorted order, -1 for null."""
    if not values:
        return F.lit(-1)
    return S.lookup(column, {v: i for i, v in enumerate(values)}, -1)


def one_hot(
    df: DataFrame, column: str, values: Sequence | None = None, prefix: str | None = None,
    keep: bool = False,
) -> DataFrame:
    """One 0/1 column ``<prefix>_<value>`` per value; null gives zeros everywhere."""
    values = category_values(df, column) if values is None else values
    stem = column if prefix is None else prefix
    flags = {
        f"{stem}_{v}": F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for v in values
    }
    out = df.withColumns(flags) if flags else df
    return out if keep else out.drop(column)


def map_vocabulary(df: DataFrame, column: str, mapping: Mapping, default) -> DataFrame:
    return df.withColumn(column, S.lookup(column, mapping, default))


# ------------------------------------------------------------------------- standardisation


def standardise(
    df: DataFrame, renames: Mapping[str, str], defaults: Mapping[str, object] | None = None,
    overrides: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rename native columns to standard ones in a single projection.

    A native column that would be shadowed by a rename target is dropped. ``defaults`` fill columns
    that are absent; ``overrides`` always replace.
    """
    targets = {new for old, new in renames.items() if old in df.columns and old != new}
    kept = [c for c in df.columns if c not in targets or renames.get(c, c) != c]
    overrides = dict(overrides or {})
    projection = [
        F.col(f"`{c}`").alias(renames.get(c, c))
        for c in kept
        if renames.get(c, c) not in overrides
    ]
    names = {renames.get(c, c) for c in kept} | set(overrides)
    projection += [expr.alias(name) for name, expr in overrides.items()]
    for name, value in (defaults or {}).items():
        if name not in names:
            column = value if isinstance(value, Column) else F.lit(value)
            projection.append(column.alias(name))
    return df.select(*projection)


def delivery_delay(delivered: str, promised: str) -> Column:
    """Whole days late (negative when early), 0 when either time is missing."""
    return F.coalesce(tm.floor_days(delivered, promised).cast("double"), F.lit(0.0))


def line_value(quantity: str, price: str) -> Column:
    return S.to_number(quantity) * S.to_number(price)


def tenure_time(months, anchor: datetime, days_per_month: int = 30) -> Column:
    """Synthetic start time: the anchor minus the tenure."""
    return tm.shift_days(tm.instant(anchor), -S.to_number(months) * F.lit(float(days_per_month)))


# -------------------------------------------------------------------------- column selection


def narrow_columns(
    df: DataFrame, protected: Sequence[str] = (), max_null_share: float = 0.95
) -> DataFrame:
    """Drop columns that are mostly null, then columns with at most one value. One scan."""
    candidates = [c for c in df.columns if c not in protected]
    if not candidates:
        return df
    # min <> max tells more than one value apart without counting the distinct ones.
    aggregates = []
    for i, c in enumerate(candidates):
        q = F.col(f"`{c}`")
        aggregates += [
            F.avg(q.isNull().cast("double")).alias(f"null_{i}"),
            (F.min(q) != F.max(q)).alias(f"varies_{i}"),
        ]
    facts = df.agg(*aggregates).first()
    dropped = [
        c
        for i, c in enumerate(candidates)
        if (facts[f"null_{i}"] or 0.0) > max_null_share or not facts[f"varies_{i}"]
    ]
    return df.drop(*dropped)


def numeric_predictors(
    df: DataFrame, id_column: str = CUSTOMER, exclude: Iterable[str] = (),
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Id plus every numeric or boolean column as double with nulls as 0."""
    skipped = {*exclude, id_column}
    numeric = (T.NumericType, T.BooleanType)
    names = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, numeric) and f.name not in skipped
        and (wanted is None or f.name in wanted)
    ]
    if wanted is not None:
        names = [c for c in wanted if c in names]
    return df.select(
        id_column,
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) for c in names],
    )


def align_columns(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give both frames the same columns in the train order; absent ones become 0.0."""
    extra = [c for c in test.columns if c not in train.columns]
    order = [*train.columns, *extra]

    def fit(df: DataFrame) -> DataFrame:
        present = set(df.columns)
        return df.select(
            *[F.col(f"`{c}`") if c in present else F.lit(0.0).alias(c) for c in order]
        )

    return fit(train), fit(test)


# ---------------------------------------------------------------------------------- slices


def history(events: DataFrame, snapshot: datetime) -> DataFrame:
    """Events strictly before the snapshot."""
    return events.where(F.col(TIME) < tm.instant(snapshot))


def is_purchase(df: DataFrame) -> Column:
    """True for order events; every row counts when there is no type column."""
    if "event_type" not in df.columns:
        return F.lit(True)
    return F.coalesce(F.col("event_type").isin(*settings.PURCHASE_TYPES), F.lit(False))


def purchases(events: DataFrame) -> DataFrame:
    return events.where(is_purchase(events))
