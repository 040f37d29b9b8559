"""Per-user timelines: history splits, cadence and rate decay labels, listening features, gaps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators import order_stats as O
from lapse.operators.assemble import ModelingData, join_labels
from lapse.operators.features import feature_matrix
from lapse.operators.labels import LABEL
from lapse.operators.splits import stratified_split
from lapse.schema import CUSTOMER, TIME, require_columns
from lapse.session import materialise


def _observed(ratio: float) -> Column:
    """True for the first max(1, floor(ratio x n)) rows of a user."""
    cut = F.greatest(F.floor(F.col("_size") * F.lit(ratio)), F.lit(1))
    return F.col("_position") <= cut


def history_split(
    df: DataFrame, key: str, order_by: str, ratio: float = 0.7, tie_breakers: Sequence[str] = (),
    row_limit: int = O.GROUP_ROW_LIMIT,
) -> DataFrame:
    """Add ``observed``: whether a row belongs to the first part of its user's own history."""
    groups = O.slice_groups(df, [key], order_by, tie_breakers, row_limit=row_limit)
    placed = O.add_positions(groups, "_position", "_size").done()
    return placed.withColumn("observed", _observed(ratio)).drop("_position", "_size")


def synthetic_timeline(
    orders: DataFrame, anchor: datetime, key: str = "user_id", number: str = "order_number",
    gap: str = "days_since_prior_order", row_limit: int = O.GROUP_ROW_LIMIT,
) -> DataFrame:
    """Add ``days_from_end`` and ``event_time`` from gaps between a user's orders.

    The running sum goes over distinct orders, newest first: the gaps of all later orders are the
    distance from the user's last order, which sits at the anchor.
    """
    filled = orders.withColumn(gap, S.to_number(gap))
    groups = O.slice_groups(filled, [key], number, descending=True, row_limit=row_limit)
    summed = O.running_totals(groups, [gap])
    away = F.col(f"run_{gap}") - F.col(gap)
    return summed.withColumn("days_from_end", away).withColumn(
        TIME, tm.shift_days(tm.instant(anchor), -F.col("days_from_end"))
    ).drop(f"run_{gap}")


def order_level(df: DataFrame) -> DataFrame:
    """One row per customer and order number."""
    return df.groupBy(CUSTOMER, "order_number").agg(
        F.min(S.to_number("days_since_prior_order", None)).alias("days_since_prior_order")
    )


def cadence_labels(
    df: DataFrame, ratio: float = 0.7, factor: float = 1.5, min_orders: int = 3,
    row_limit: int = O.GROUP_ROW_LIMIT,
) -> DataFrame:
    """customer_id, lapsed, last_observed: 1 when the later mean gap exceeds factor x the earlier one.

    Users with fewer than ``min_orders`` orders, or without a positive gap on either side, drop out.
    ``last_observed`` is the last order number of the earlier part.
    """
    require_columns(
        df, [CUSTOMER, "order_number", "days_since_prior_order"], "user-relative split"
    )
    groups = O.slice_groups(order_level(df), [CUSTOMER], "order_number", row_limit=row_limit)
    placed = O.add_positions(groups, "_position", "_size").done()
    early = _observed(ratio)
    gap = F.when(F.col("days_since_prior_order") != 0, F.col("days_since_prior_order"))
    means = (
        placed.where(F.col("_size") >= min_orders)
        .groupBy(CUSTOMER)
        .agg(
            F.avg(F.when(early, gap)).alias("_early"),
            F.avg(F.when(~early, gap)).alias("_late"),
            F.max(F.when(early, F.col("order_number"))).alias("last_observed"),
        )
    )
    known = means.where(F.col("_early").isNotNull() & F.col("_late").isNotNull())
    lapsed = F.when(F.col("_late") > F.lit(factor) * F.col("_early"), 1).otherwise(0)
    return known.select(CUSTOMER, lapsed.alias(LABEL), "last_observed")


def observed_events(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Events of the labelled users up to the last order of their earlier part."""
    joined = df.join(labels.select(CUSTOMER, "last_observed"), CUSTOMER, "inner")
    return joined.where(F.col("order_number") <= F.col("last_observed")).drop("last_observed")


def cadence_table(
    df: DataFrame, groups: Sequence[str] | None = None, ratio: float = 0.7
) -> DataFrame:
    """customer_id, lapsed and features of the earlier part, one day after its last event."""
    # Read three times below: for the snapshot, the features and the labels.
    labels = materialise(cadence_labels(df, ratio))
    source = observed_events(df, labels)
    last = source.agg(F.max(tm.micros(TIME)).alias("m")).first()["m"]
    if last is None:
        raise RuntimeError("no user qualifies for the user-relative split")
    snapshot = tm.plus_days(tm.from_micros(last), 1)
    return join_labels(feature_matrix(source, snapshot, groups), labels)


def _relative(table: DataFrame, share: float, seed: int) -> ModelingData:
    table = materialise(table)
    train, test = stratified_split(table, LABEL, share, seed=seed, salt="relative")
    return ModelingData(
        train, test, "user_relative", "user_relative_observation", "user_relative_future"
    )


def cadence_split(
    df: DataFrame, groups: Sequence[str] | None = None, ratio: float = 0.7, seed: int = 42
) -> ModelingData:
    return _relative(cadence_table(df, groups, ratio), 0.30, seed)


# ----------------------------------------------------------------------------- listening decay


def listening_table(
    df: DataFrame, ratio: float = 0.7, factor: float = 0.5, min_rows: int = 50,
    track: str = "track_name", row_limit: int = O.GROUP_ROW_LIMIT,
) -> DataFrame:
    """customer_id, lapsed and nine listening features of the earlier part of each history.

    lapsed is 1 when the later listens per day fall below factor x the earlier rate.
    """
    used = [c for c in ("product_id", track) if c in df.columns]
    events = df.where(F.col(CUSTOMER).isNotNull() & F.col(TIME).isNotNull())
    events = events.select(CUSTOMER, TIME, *used)
    groups = O.slice_groups(events, [CUSTOMER], TIME, used, row_limit=row_limit)
    placed = O.add_previous(O.add_positions(groups, "_position", "_size"), TIME, "_before").done()
    placed = placed.where(F.col("_size") >= min_rows)

    early = _observed(ratio)
    in_early = lambda c: F.when(early, c)
    gap = in_early(tm.seconds_between(TIME, "_before") / F.lit(86400.0))
    distinct = lambda c: (
        F.count_distinct(in_early(F.col(c))) if c in used else F.lit(0).cast("long")
    )
    facts = placed.groupBy(CUSTOMER).agg(
        F.count(in_early(F.lit(1))).alias("total_listens"),
        F.count(F.when(~early, 1)).alias("_later"),
        F.min(in_early(F.col(TIME))).alias("_e0"),
        F.max(in_early(F.col(TIME))).alias("_e1"),
        F.min(F.when(~early, F.col(TIME))).alias("_l0"),
        F.max(F.when(~early, F.col(TIME))).alias("_l1"),
        distinct("product_id").alias("unique_artists"),
        distinct(track).alias("unique_tracks"),
        F.count_distinct(in_early(F.to_date(TIME))).alias("active_days"),
        F.max(gap).alias("_gap"),
    ).where(F.col("_later") > 0)
    days = lambda a, z: F.greatest(tm.floor_days(z, a) + 1, F.lit(1))
    early_rate = F.col("total_listens") / days("_e0", "_e1")
    late_rate = F.col("_later") / days("_l0", "_l1")
    total = F.col("total_listens").cast("double")
    per_day = total / F.greatest("active_days", F.lit(1))
    return facts.select(
        CUSTOMER,
        F.when(late_rate < F.lit(factor) * early_rate, 1).otherwise(0).alias(LABEL),
        total.alias("total_listens"),
        F.col("unique_artists").cast("double").alias("unique_artists"),
        F.col("unique_tracks").cast("double").alias("unique_tracks"),
        F.col("active_days").cast("double").alias("active_days"),
        per_day.alias("avg_listens_per_day"),
        # The history is in time order, so its last row is its latest: always 0, kept as a column.
        F.lit(0.0).alias("days_since_last_listen"),
        F.coalesce("_gap", F.lit(0.0)).alias("max_gap_between_sessions"),
        per_day.alias("listening_frequency"),
        (F.col("unique_artists") / F.greatest(total, F.lit(1.0))).alias("artist_diversity_ratio"),
    )


def listening_split(df: DataFrame, ratio: float = 0.7, seed: int = 42) -> ModelingData:
    return _relative(listening_table(df, ratio), 0.30, seed)


# ------------------------------------------------------------------------------------- gaps


def inter_event_days(
    events: DataFrame, row_limit: int = O.GROUP_ROW_LIMIT, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Whole days since the customer's previous event, one row per event that has one."""
    narrow = events.where(F.col(CUSTOMER).isNotNull()).select(CUSTOMER, TIME, *tie_breakers)
    groups = O.slice_groups(narrow, [CUSTOMER], TIME, tie_breakers, row_limit=row_limit)
    linked = O.previous_value(groups, TIME, "_before").where(F.col("_before").isNotNull())
    return linked.select(CUSTOMER, tm.floor_days(TIME, "_before").alias("gap_days"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Mean and exact median gap.

    Gaps are whole days, so counting by value leaves at most one row per day of the data span; the
    exact percentile then works on that bounded table with frequencies.
    """
    counted = gaps.groupBy("gap_days").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.percentile("gap_days", 0.5, F.col("n")).alias("median_days"),
        (F.sum(F.col("gap_days") * F.col("n")) / F.sum("n")).alias("mean_days"),
    )
