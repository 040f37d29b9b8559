from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lapse.operators import labels as L
from lapse.operators.features import feature_matrix, null_features

UTC = timezone.utc


def at(day, hour=0):
    return datetime(2020, 1, day, hour, tzinfo=UTC)


SCHEMA = (
    "customer_id string, event_time timestamp, event_type string, product_id string, "
    "transaction_value double, review_score double, payment_type string, delivery_delay double, "
    "session_id string, engagement_signal double"
)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        ("a", at(1), "purchase", "p", 10.0, 5.0, "card", 2.0, "s1", 3.0),
        ("a", at(1), "purchase", None, 5.0, 3.0, "cash", None, "s1", 3.0),
        ("a", at(4), "order", "q", None, 0.0, "cash", -1.0, None, 1.0),
        ("a", at(5), "view", "q", None, None, None, None, None, None),
        ("a", at(10), "purchase", "q", 99.0, 1.0, "card", 9.0, "s9", 3.0),
        ("b", at(2), "view", "p", None, None, None, None, "s1", 1.0),
        ("b", at(3), "wishlist", "p", None, None, None, None, "s1", 1.0),
        ("c", at(3), "purchase", "p", 7.0, 4.0, None, 0.0, "s2", 3.0),
        (None, at(3), "purchase", "p", 7.0, 4.0, "card", 0.0, "s2", 3.0),
        ("d", at(11), "purchase", "p", 7.0, 4.0, "card", 0.0, "s2", 3.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return {r["customer_id"]: r.asDict() for r in df.collect()}


def test_matrix_by_hand(events):
    got = rows(feature_matrix(events, at(10)))
    assert set(got) == {"a", "b", "c"}  # the event at the snapshot does not count
    a, b, c = got["a"], got["b"], got["c"]
    assert a["total_orders"] == 2 and a["total_items_purchased"] == 2
    assert a["repeat_purchase_ratio"] == 1.0 and c["repeat_purchase_ratio"] == 0.0
    # values per order time: 15 and (all null) 0
    assert (a["total_spent"], a["avg_order_value"]) == (15.0, 7.5)
    assert (a["max_order_value"], a["min_order_value"]) == (15.0, 0.0)
    assert a["days_since_last_purchase"] == 6 and b["days_since_last_purchase"] == 0
    assert a["avg_review_score"] == 4.0 and a["review_variance"] == 2.0
    assert a["low_review_ratio"] == 0.5 and a["positive_review_ratio"] == 0.5
    assert c["review_variance"] == 0.0
    assert a["avg_delivery_delay_days"] == pytest.approx(1 / 3)
    assert a["max_delivery_delay"] == 2.0
    assert a["delayed_order_ratio"] == pytest.approx(1 / 3)
    assert a["on_time_delivery_ratio"] == pytest.approx(2 / 3)
    # first row per order time: card/10 and cash/null; tie goes to the smaller name
    assert a["avg_payment_value"] == 10.0
    assert a["pay_type__card"] == 1.0 and a["pay_type__cash"] == 0.0
    assert c["pay_type__unknown"] == 1.0 and b["pay_type__unknown"] == 0.0
    assert a["total_events"] == 4 and a["total_page_views"] == 1 and a["total_purchases"] == 2
    assert a["total_sessions"] == 2 and a["avg_actions_per_session"] == 2.0  # null is a session
    assert b["total_wishlist_adds"] == 1 and b["total_sessions"] == 1
    assert a["avg_engagement_signal"] == pytest.approx(7 / 3)
    assert a["customer_lifetime_days"] == 3 and a["avg_days_between_orders"] == 3
    assert a["avg_orders_per_month"] == pytest.approx(2 / (3 / 30.44))
    assert c["avg_days_between_orders"] == 0 and c["avg_orders_per_month"] == 0


def test_no_nulls_and_two_snapshots_agree(events):
    both = feature_matrix(events, {"train": at(4), "test": at(12)})
    assert null_features(both).first()["n_null"] == 0
    for name, day in (("train", 4), ("test", 12)):
        types = ["card", "cash", "unknown"]
        one = rows(feature_matrix(events, at(day), payment_types=types))
        side = rows(
            feature_matrix(events, {"train": at(4), "test": at(12)}, payment_types=types)
            .where(F.col("point") == name).drop("point")
        )
        assert one == side


def test_order_only_groups_leave_out_browsers(events):
    got = rows(feature_matrix(events, at(10), ["purchase", "cadence"]))
    assert set(got) == {"a", "c"}


def test_later_events_change_nothing(events, spark):
    extra = spark.createDataFrame(
        [("a", at(10, 1), "purchase", "z", 1e6, 1.0, "card", 50.0, "sx", 3.0)], SCHEMA
    )
    types = ["card", "cash", "unknown"]
    before = rows(feature_matrix(events, at(10), payment_types=types))
    after = rows(feature_matrix(events.unionByName(extra), at(10), payment_types=types))
    assert before == after


def test_missing_columns_switch_groups_off(events):
    narrow = events.select("customer_id", "event_time", "event_type")
    got = feature_matrix(narrow, at(10))
    assert "total_spent" not in got.columns and "total_orders" in got.columns
    assert rows(got)["a"]["total_items_purchased"] == 3  # rows when there is no product column


def test_labels_by_hand(events):
    got = {r["customer_id"]: r["lapsed"] for r in L.inactivity_labels(events, at(4), 6).collect()}
    # a returns on days 5 and 10 (the end is inclusive); the event on day 4 itself is in neither side
    assert got == {"a": 0, "b": 1, "c": 1}
    got = {r["customer_id"]: r["lapsed"] for r in L.inactivity_labels(events, at(5), 4).collect()}
    assert got["a"] == 1
