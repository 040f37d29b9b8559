"""Feature groups and the full matrix on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import assemble as A
from lapse.operators import labels as L
from lapse.operators.features import feature_matrix
from lapse.plans.driver import sql as Q
from lapse.plans.driver.registry import query
from lapse.sources import driver as D

_MARKET_SLICE = f"""
WITH {Q.MARKET.strip()}, {Q.cutoffs('market', 180).strip()}, {Q.points().strip()},
m AS (SELECT point, s, market.* FROM market, points WHERE t < s),
o AS (SELECT point, any_value(s) AS s, customer_id, t, sum(value) AS v, count(*) AS n,
             count(product_id) AS products FROM m GROUP BY point, customer_id, t)"""

_CLICK_SLICE = f"""
WITH {Q.CLICK.strip()}, {Q.cutoffs('click', 1).strip()}, {Q.points().strip()},
m AS (SELECT point, s, click.* FROM click, points WHERE t < s),
o AS (SELECT point, any_value(s) AS s, customer_id, t, sum(value) AS v, count(*) AS n
      FROM m WHERE kind = 'purchase' GROUP BY point, customer_id, t)"""

_LIFE = f"floor((max(t) - min(t)) / {Q.DAY}.0)"

_ORDER_FEATURES = {
    "purchase": """count(*)::DOUBLE AS total_orders, sum(products)::DOUBLE AS total_items_purchased,
       (count(*) > 1)::INT::DOUBLE AS repeat_purchase_ratio""",
    "monetary": """round(sum(v), 2) AS total_spent, round(avg(v) + 0.0000137, 4) AS avg_order_value,
       max(v) AS max_order_value, min(v) AS min_order_value""",
    "inactivity": f"greatest(floor((any_value(s) - max(t)) / {Q.DAY}.0), 0)::DOUBLE AS days_since_last_purchase",
    "cadence": f"""{_LIFE}::DOUBLE AS customer_lifetime_days,
       CASE WHEN count(*) > 1 THEN {_LIFE} / (count(*) - 1) ELSE 0 END::DOUBLE AS avg_days_between_orders,
       CASE WHEN {_LIFE} > 0 THEN count(*) / ({_LIFE} / 30.44) ELSE 0 END::DOUBLE AS avg_orders_per_month""",
}
# Money is compared in cents. Means of cents often end exactly on a rounding tie, where the last bit
# of a sum decides, so both sides move off the tie before rounding.
_OFF_TIE = 0.0000137


def _rounded(df):
    moved = {c: F.round(F.col(c) + _OFF_TIE, 4) for c in ("avg_order_value", "avg_payment_value")}
    rounded = {
        "total_spent": F.round("total_spent", 2),
        "review_variance": F.round("review_variance", 9), **moved}
    return df.withColumns({c: e for c, e in rounded.items() if c in df.columns})


def _market_points(spark, sf, with_items=True):
    events = D.market_events(spark, sf, with_items)
    cut = L.global_cutoffs(D.market_events(spark, sf, False), 180)
    return events, {"train": cut.train, "test": cut.test}


def _click_points(spark, sf):
    events = D.click_events(spark, sf)
    cut = L.global_cutoffs(events, 1)
    return events, {"train": cut.train, "test": cut.test}


def _order_group(group):
    return f"""{_MARKET_SLICE}
SELECT point, customer_id, {_ORDER_FEATURES[group]} FROM o GROUP BY point, customer_id"""


@query("G1 G2 G3", _order_group("purchase"))
def purchase_features(spark, sf):
    events, points = _market_points(spark, sf)
    return feature_matrix(events, points, ["purchase"])


@query("G4", _order_group("monetary"))
def monetary_features(spark, sf):
    events, points = _market_points(spark, sf, with_items=False)
    return _rounded(feature_matrix(events, points, ["monetary"]))


@query("G5", _order_group("inactivity"))
def inactivity_features(spark, sf):
    events, points = _market_points(spark, sf, with_items=False)
    return feature_matrix(events, points, ["inactivity"])


@query("G18 G19 G20", _order_group("cadence"))
def cadence_features(spark, sf):
    events, points = _market_points(spark, sf, with_items=False)
    return feature_matrix(events, points, ["cadence"])


@query("G6 G7", f"""{_MARKET_SLICE}
SELECT point, customer_id, avg(review_score) AS avg_review_score, min(review_score) AS min_review_score,
       round(coalesce(var_samp(review_score), 0), 9) AS review_variance,
       avg((review_score <= 3)::INT) AS low_review_ratio, avg((review_score >= 4)::INT) AS positive_review_ratio
FROM m WHERE review_score > 0 GROUP BY point, customer_id""")
def review_features(spark, sf):
    events, points = _market_points(spark, sf)
    return _rounded(feature_matrix(events, points, ["review"]))


@query("G8 G9", f"""{_MARKET_SLICE}
SELECT point, customer_id, avg(delay) AS avg_delivery_delay_days, max(delay) AS max_delivery_delay,
       avg((delay > 0)::INT) AS delayed_order_ratio, avg((delay <= 0)::INT) AS on_time_delivery_ratio
FROM m GROUP BY point, customer_id""")
def delivery_features(spark, sf):
    events, points = _market_points(spark, sf)
    return feature_matrix(events, points, ["delivery"])


_PAYMENT_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PAYMENT = """
firsts AS (SELECT point, customer_id, t, payment_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY point, customer_id, t ORDER BY payment_type, value) AS k FROM m)
  WHERE k = 1),
paid AS (SELECT point, customer_id, avg(value) AS avg_payment_value FROM firsts GROUP BY 1, 2),
kinds AS (SELECT point, customer_id, payment_type, count(*) AS n FROM firsts GROUP BY 1, 2, 3),
pref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point, customer_id
  ORDER BY n DESC, payment_type) AS k FROM kinds) WHERE k = 1)"""
_PAYMENT_COLUMNS = ", ".join(
    f"(payment_type = '{v}')::INT::DOUBLE AS \"pay_type__{v}\"" for v in _PAYMENT_TYPES)


@query("G10 G11 G12", f"""{_MARKET_SLICE}, {_PAYMENT.strip()}
SELECT point, customer_id, round(avg_payment_value + 0.0000137, 4) AS avg_payment_value, {_PAYMENT_COLUMNS},
       0.0::DOUBLE AS avg_payment_installments
FROM paid JOIN pref USING (point, customer_id)""")
def payment_features(spark, sf):
    events, points = _market_points(spark, sf, with_items=False)
    return _rounded(feature_matrix(events, points, ["payment"]))


_ENGAGEMENT = """
  count(*) FILTER (WHERE kind = 'view')::DOUBLE AS total_page_views,
  count(*) FILTER (WHERE kind = 'cart_add')::DOUBLE AS total_cart_adds,
  count(*) FILTER (WHERE kind = 'purchase')::DOUBLE AS total_purchases,
  count(*) FILTER (WHERE kind = 'wishlist')::DOUBLE AS total_wishlist_adds,
  count(kind)::DOUBLE AS total_events,
  count(DISTINCT coalesce(session_id, '-'))::DOUBLE AS total_sessions,
  count(kind) / greatest(count(DISTINCT coalesce(session_id, '-')), 1) AS avg_actions_per_session,
  coalesce(avg(signal), 0) AS avg_engagement_signal"""


@query("G13 G14 G15 G16 G17", f"""{_CLICK_SLICE}
SELECT point, customer_id, {_ENGAGEMENT} FROM m GROUP BY point, customer_id""")
def engagement_features(spark, sf):
    events, points = _click_points(spark, sf)
    return feature_matrix(events, points, ["engagement"])


@query("G21 J8 G22", f"""{_CLICK_SLICE},
eng AS (SELECT point, customer_id, {_ENGAGEMENT} FROM m GROUP BY point, customer_id),
ord AS (SELECT point, customer_id, count(*)::DOUBLE AS total_orders, sum(n)::DOUBLE AS total_items_purchased,
        (count(*) > 1)::INT::DOUBLE AS repeat_purchase_ratio, {_ORDER_FEATURES['monetary']},
        {_ORDER_FEATURES['inactivity']}, {_ORDER_FEATURES['cadence']} FROM o GROUP BY point, customer_id)
SELECT eng.*, coalesce(total_orders, 0) AS total_orders,
       coalesce(total_items_purchased, 0) AS total_items_purchased,
       coalesce(repeat_purchase_ratio, 0) AS repeat_purchase_ratio, coalesce(total_spent, 0) AS total_spent,
       coalesce(avg_order_value, 0) AS avg_order_value, coalesce(max_order_value, 0) AS max_order_value,
       coalesce(min_order_value, 0) AS min_order_value,
       coalesce(days_since_last_purchase, 0) AS days_since_last_purchase,
       coalesce(customer_lifetime_days, 0) AS customer_lifetime_days,
       coalesce(avg_days_between_orders, 0) AS avg_days_between_orders,
       coalesce(avg_orders_per_month, 0) AS avg_orders_per_month
FROM eng LEFT JOIN ord USING (point, customer_id)""")
def click_feature_matrix(spark, sf):
    """All groups of the event stream; customers without purchases get zeros."""
    events, points = _click_points(spark, sf)
    return _rounded(feature_matrix(
        events, points, ["purchase", "monetary", "inactivity", "engagement", "cadence"]))


@query("G21 J8 J14 P23 L2", f"""{_MARKET_SLICE}, {_PAYMENT.strip()},
{Q.labels('market', 180).strip()},
ord AS (SELECT point, customer_id, {_ORDER_FEATURES['purchase']}, {_ORDER_FEATURES['monetary']},
        {_ORDER_FEATURES['inactivity']}, {_ORDER_FEATURES['cadence']} FROM o GROUP BY point, customer_id),
rev AS (SELECT point, customer_id, avg(review_score) AS avg_review_score, min(review_score) AS min_review_score,
        round(coalesce(var_samp(review_score), 0), 9) AS review_variance, avg((review_score <= 3)::INT) AS low_review_ratio,
        avg((review_score >= 4)::INT) AS positive_review_ratio
        FROM m WHERE review_score > 0 GROUP BY point, customer_id),
del AS (SELECT point, customer_id, avg(delay) AS avg_delivery_delay_days, max(delay) AS max_delivery_delay,
        avg((delay > 0)::INT) AS delayed_order_ratio, avg((delay <= 0)::INT) AS on_time_delivery_ratio
        FROM m GROUP BY point, customer_id),
pay AS (SELECT point, customer_id, round(avg_payment_value + 0.0000137, 4) AS avg_payment_value, {_PAYMENT_COLUMNS},
        0.0::DOUBLE AS avg_payment_installments FROM paid JOIN pref USING (point, customer_id))
SELECT ord.*, lapsed, coalesce(avg_review_score, 0) AS avg_review_score,
       coalesce(min_review_score, 0) AS min_review_score, coalesce(review_variance, 0) AS review_variance,
       coalesce(low_review_ratio, 0) AS low_review_ratio,
       coalesce(positive_review_ratio, 0) AS positive_review_ratio,
       del.* EXCLUDE (point, customer_id), pay.* EXCLUDE (point, customer_id)
FROM ord LEFT JOIN rev USING (point, customer_id) JOIN del USING (point, customer_id)
JOIN pay USING (point, customer_id) JOIN labelled USING (point, customer_id)""")
def order_modeling_table(spark, sf):
    """Every order-based feature at both snapshots with labels: the flagship table."""
    events = D.market_events(spark, sf)
    cut = L.global_cutoffs(D.market_events(spark, sf, False), 180)
    table = A.global_table(
        events, cut,
        ["purchase", "monetary", "inactivity", "review", "delivery", "payment", "cadence"])
    return _rounded(table)


