"""Customer x feature matrix from events strictly before one or more snapshots.

Plan shape, for any number of snapshots and feature groups:

1. one scan; rows combine per (customer, era, order time), where the era says which snapshots a row
   precedes and the order time is null for everything that is not an order. Browsing events of a
   customer therefore collapse on the map side, and the orders of a hot customer spread over tasks.
2. each combined row is repeated for the snapshots it precedes and combines per (customer, snapshot).
3. session counts, when asked for, are a second narrow branch over (customer, session).

No step gathers the events of one customer in a task, and no id list travels through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators.clean import category_values, is_purchase
from lapse.schema import CUSTOMER, REQUIRED_COLUMNS, TIME, available_groups, require_columns
from lapse.settings import PAYMENT_PREFIX

POINT = "point"
_ORDER_GROUPS = ("purchase", "monetary", "inactivity", "delivery", "payment", "cadence")
_UNKNOWN = "unknown"
_MONTH_DAYS = 30.44


def payment_values(events: DataFrame) -> list[str]:
    """Payment types a one-hot column is made for; a null type stands for 'unknown'."""
    orders = events.where(is_purchase(events))
    return category_values(
        orders.select(F.coalesce("payment_type", F.lit(_UNKNOWN)).alias("payment_type")),
        "payment_type",
    )


def payment_column(value: str) -> str:
    return f"{PAYMENT_PREFIX}_{value}"


def _num(name: str) -> Column:
    return F.col(name).cast("double")


class _Plan:
    """Aggregates of both levels and the final expressions, collected group by group."""

    def __init__(self) -> None:
        self.combine: dict[str, Column] = {}
        self.reduce: dict[str, Column] = {}
        self.final: dict[str, Column] = {}

    def add(self, name: str, combine: Column, reduce: Column | None = None) -> None:
        self.combine[name] = combine
        self.reduce[name] = F.sum(name) if reduce is None else reduce

    def out(self, name: str, value: Column) -> None:
        self.final[name] = F.coalesce(value.cast("double"), F.lit(0.0))


def _plan_purchase(plan: _Plan, columns, order: Column) -> None:
    item = F.col("product_id").isNotNull() if "product_id" in columns else F.lit(True)
    plan.add("_items", S.count_where(order & item))
    plan.out("total_orders", F.col("_orders"))
    plan.out("total_items_purchased", F.col("_items"))
    plan.out("repeat_purchase_ratio", F.when(F.col("_orders") > 1, 1.0).otherwise(0.0))


def _plan_monetary(plan: _Plan, order: Column) -> None:
    # A null sum (all values missing) is an order of value 0.
    value = F.coalesce(F.sum(F.when(order, _num("transaction_value"))), F.lit(0.0))
    plan.combine["_value"] = value
    worth = F.when(F.col("_order_time").isNotNull(), F.col("_value"))
    plan.reduce["_spent"] = F.sum(worth)
    plan.reduce["_value_max"] = F.max(worth)
    plan.reduce["_value_min"] = F.min(worth)
    plan.out("total_spent", F.col("_spent"))
    plan.out("avg_order_value", S.ratio("_spent", "_orders"))
    plan.out("max_order_value", F.col("_value_max"))
    plan.out("min_order_value", F.col("_value_min"))


def _plan_review(plan: _Plan) -> None:
    score = F.when(_num("review_score") > 0, _num("review_score"))
    plan.add("_rated", F.count(score))
    plan.add("_score", F.sum(score))
    plan.add("_square", F.sum(score * score))
    plan.add("_score_min", F.min(score), F.min("_score_min"))
    plan.add("_low", F.count(F.when(score <= 3, 1)))
    plan.add("_high", F.count(F.when(score >= 4, 1)))
    n, total = F.col("_rated"), F.col("_score")
    plan.out("avg_review_score", S.ratio(total, n))
    plan.out("min_review_score", F.col("_score_min"))
    # Ratings are small whole numbers, for which the moment form is exact.
    spread = F.greatest(F.col("_square") - total * total / n, F.lit(0.0)) / (n - 1)
    plan.out("review_variance", F.when(n > 1, spread))
    plan.out("low_review_ratio", S.ratio("_low", n))
    plan.out("positive_review_ratio", S.ratio("_high", n))


def _plan_delivery(plan: _Plan, order: Column) -> None:
    delay = F.when(order, F.coalesce(_num("delivery_delay"), F.lit(0.0)))
    plan.add("_delay", F.sum(delay))
    plan.add("_delay_max", F.max(delay), F.max("_delay_max"))
    plan.add("_late", F.count(F.when(delay > 0, 1)))
    plan.out("avg_delivery_delay_days", S.ratio("_delay", "_order_rows"))
    plan.out("max_delivery_delay", F.col("_delay_max"))
    plan.out("delayed_order_ratio", S.ratio("_late", "_order_rows"))
    on_time = F.col("_order_rows") - F.col("_late")
    plan.out("on_time_delivery_ratio", S.ratio(on_time, "_order_rows"))


def _plan_payment(plan: _Plan, columns, order: Column, values: Sequence[str]) -> None:
    worth = _num("transaction_value") if "transaction_value" in columns else F.lit(None)
    kind = F.col("payment_type")
    # Several rows at one order time: the smallest (type, value) row stands for the order.
    first = F.min(
        F.when(
            order,
            F.struct(
                kind.isNull().alias("no_kind"), kind.alias("kind"),
                worth.isNull().alias("no_worth"), worth.cast("double").alias("worth"),
            ),
        )
    )
    plan.combine["_payment"] = first
    is_order = F.col("_order_time").isNotNull()
    plan.reduce["_paid"] = F.avg(F.when(is_order, F.col("_payment.worth")))
    for i, v in enumerate(values):
        hit = is_order & (F.col("_payment.kind") == F.lit(v))
        plan.reduce[f"_kind_{i}"] = S.count_where(hit)
    plan.out("avg_payment_value", F.col("_paid"))
    counts = [F.col(f"_kind_{i}") for i in range(len(values))]
    top = F.greatest(*counts) if len(counts) > 1 else counts[0] if counts else F.lit(0)
    preferred = F.when(top <= 0, F.lit(_UNKNOWN))
    for i, v in enumerate(values):
        preferred = preferred.when(counts[i] == top, F.lit(v))
    has_orders = F.col("_orders") > 0
    for v in values:
        plan.out(payment_column(v), F.when(has_orders & (preferred == F.lit(v)), 1.0))
    plan.out("avg_payment_installments", F.lit(0.0))


def _plan_engagement(plan: _Plan, columns) -> None:
    kind = F.col("event_type")
    names = {
        "view": "total_page_views", "cart_add": "total_cart_adds",
        "purchase": "total_purchases", "wishlist": "total_wishlist_adds",
    }
    for value, feature in names.items():
        plan.add(f"_n_{value}", F.count(F.when(kind == value, 1)))
        plan.out(feature, F.col(f"_n_{value}"))
    plan.add("_typed", F.count(kind))
    plan.out("total_events", F.col("_typed"))
    if "session_id" in columns:
        plan.out("total_sessions", F.col("_sessions"))
        plan.out(
            "avg_actions_per_session",
            F.col("_typed") / F.greatest(F.coalesce("_sessions", F.lit(1)), F.lit(1)),
        )
    else:
        plan.out("total_sessions", F.lit(0.0))
        plan.out("avg_actions_per_session", F.lit(0.0))
    if "engagement_signal" in columns:
        plan.add("_signal", F.sum(_num("engagement_signal")))
        plan.add("_signals", F.count("engagement_signal"))
        plan.out("avg_engagement_signal", S.ratio("_signal", "_signals"))


def _plan_cadence(plan: _Plan) -> None:
    orders = F.col("_orders")
    life = tm.elapsed_days("_last", "_first").cast("double")
    plan.out("customer_lifetime_days", life)
    plan.out("avg_days_between_orders", F.when(orders > 1, life / (orders - 1)))
    plan.out("avg_orders_per_month", F.when(life > 0, orders / (life / F.lit(_MONTH_DAYS))))


def feature_matrix(
    events: DataFrame,
    snapshots: datetime | Mapping[str, datetime],
    groups: Sequence[str] | None = None,
    customers: DataFrame | None = None,
    payment_types: Sequence[str] | None = None,
) -> DataFrame:
    """Wide matrix of doubles without nulls, one row per customer (and per named snapshot).

    ``snapshots`` is one instant, or names mapped to instants; the latter adds a ``point`` column.
    ``groups`` limits the feature groups; a group whose columns are absent is skipped. Customers
    for whom no group has anything to say do not appear. ``customers`` keeps listed ids only.
    ``payment_types`` fixes the one-hot vocabulary; by default it is read from the events.
    """
    require_columns(events, REQUIRED_COLUMNS, "feature matrix")
    named = snapshots if isinstance(snapshots, Mapping) else {"snapshot": snapshots}
    points = sorted(named.items(), key=lambda item: item[1])
    active = available_groups(events, groups)
    if not active:
        raise ValueError("no feature group can run on these columns")
    columns = set(events.columns)

    history = events.where(
        F.col(CUSTOMER).isNotNull() & (F.col(TIME) < tm.instant(points[-1][1]))
    )
    if customers is not None:
        history = history.join(customers.select(CUSTOMER), CUSTOMER, "left_semi")

    # Marked once, so later expressions and the vocabulary agree on what an order is.
    order = F.col("_order")
    marked = history.withColumn("_order", is_purchase(history))
    marked = marked.withColumn("_order_time", F.when(order, F.col(TIME)))

    plan = _Plan()
    plan.add("_order_rows", S.count_where(order))
    plan.reduce["_orders"] = F.count("_order_time")
    plan.reduce["_first"] = F.min("_order_time")
    plan.reduce["_last"] = F.max("_order_time")
    if "purchase" in active:
        _plan_purchase(plan, columns, order)
    if "monetary" in active:
        _plan_monetary(plan, order)
    if "inactivity" in active:
        cut = F.col("_cut")
        plan.out("days_since_last_purchase", tm.elapsed_days(cut, F.col("_last")))
    if "review" in active:
        _plan_review(plan)
    if "delivery" in active:
        _plan_delivery(plan, order)
    if "payment" in active:
        values = payment_values(history) if payment_types is None else list(payment_types)
        _plan_payment(plan, columns, order, values)
    if "engagement" in active:
        _plan_engagement(plan, columns)
    if "cadence" in active:
        _plan_cadence(plan)

    keys = [CUSTOMER]
    era = S.edges_passed(F.col(TIME), [tm.instant(at) for _, at in points[:-1]], True) \
        if len(points) > 1 else F.lit(0)
    combined = (
        marked.withColumn("_era", era)
        .groupBy(CUSTOMER, "_era", "_order_time")
        .agg(*[c.alias(n) for n, c in plan.combine.items()])
    )
    spread = _per_snapshot(combined, len(points))
    wide = spread.groupBy(*keys, "_at").agg(*[c.alias(n) for n, c in plan.reduce.items()])
    if "engagement" in active and "session_id" in columns:
        wide = wide.join(_sessions(history, points), [*keys, "_at"], "left")

    order_groups = any(g in _ORDER_GROUPS for g in active)
    present = F.lit("engagement" in active)
    if order_groups:
        present = present | (F.col("_order_rows") > 0)
    if "review" in active:
        present = present | (F.col("_rated") > 0)
    cut = F.element_at(F.array(*[tm.instant(at) for _, at in points]), F.col("_at") + 1)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in points]), F.col("_at") + 1)
    lead = [name.alias(POINT)] if isinstance(snapshots, Mapping) else []
    return (
        wide.where(present)
        .withColumn("_cut", cut)
        .select(*lead, CUSTOMER, *[c.alias(n) for n, c in plan.final.items()])
    )


def _per_snapshot(rows: DataFrame, count: int) -> DataFrame:
    """Repeat each row for every snapshot at or after its era."""
    if count == 1:
        return rows.withColumn("_at", F.lit(0))
    return rows.withColumn("_at", F.explode(F.sequence(F.col("_era"), F.lit(count - 1))))


def _sessions(history: DataFrame, points) -> DataFrame:
    """Distinct sessions per customer and snapshot; all null sessions count as one."""
    first = history.groupBy(CUSTOMER, "session_id").agg(F.min(TIME).alias("_start"))
    edges = [tm.instant(at) for _, at in points[:-1]]
    era = S.edges_passed(F.col("_start"), edges, True) if edges else F.lit(0)
    spread = _per_snapshot(first.withColumn("_era", era), len(points))
    return spread.groupBy(CUSTOMER, "_at").agg(F.count(F.lit(1)).alias("_sessions"))


def feature_columns(matrix: DataFrame) -> list[str]:
    """Feature names of a matrix or a labelled matrix."""
    from lapse.operators.labels import LABEL

    return [c for c in matrix.columns if c not in (CUSTOMER, POINT, LABEL, "cohort")]


def null_features(matrix: DataFrame) -> DataFrame:
    """One row: how many rows of the matrix hold a null or NaN feature (always 0)."""
    bad = F.lit(False)
    for c in feature_columns(matrix):
        bad = bad | F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`"))
    return matrix.agg(S.count_where(bad).alias("n_null"))
