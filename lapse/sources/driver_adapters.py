"""The star-schema tables as datasets, so every workflow can run on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from lapse.operators import clean as K
from lapse.operators import labels as L
from lapse.schema import CUSTOMER
from lapse.sources import driver as D
from lapse.sources.adapter import Adapter, join_path

COMMON = ("purchase", "monetary", "inactivity", "cadence")


@dataclass(frozen=True)
class StarOrders(Adapter):
    """Orders on the global split."""

    def inputs(self, root):
        return [(t, [join_path(root, f"{t}.parquet")]) for t in ("orders", "lineitem")]

    def load(self, spark, root):
        return D.market_events(spark, root)


@dataclass(frozen=True)
class StarShipments(Adapter):
    """Line items per order on the user-disjoint split."""

    def inputs(self, root):
        return [("lineitem", [join_path(root, "lineitem.parquet")])]

    def load(self, spark, root):
        return D.shipment_events(spark, root)


@dataclass(frozen=True)
class StarClicks(Adapter):
    """The event stream on the global split with a one-day window."""

    def inputs(self, root):
        return [("events", [join_path(root, "events.parquet")])]

    def load(self, spark, root):
        return D.table(spark, root, "events")

    def standard(self, clean):
        return D.map_clicks(clean)


@dataclass(frozen=True)
class StarSubscribers(Adapter):
    """Customers with a native label."""

    def inputs(self, root):
        return [("customer", [join_path(root, "customer.parquet")])]

    def load(self, spark, root):
        return D.subscribers(spark, root)

    def clean(self, raw):
        labelled = raw.withColumn("lapsed", K.label_from_text("Lapsed", "Yes"))
        return K.one_hot(labelled, "segment")

    def standard(self, clean):
        return clean.withColumn("event_time", F.to_timestamp(F.lit("2019-01-01")))

    def native_labels(self, events):
        return L.native_labels(events)

    def predictors(self, events):
        return K.numeric_predictors(events, CUSTOMER, exclude=["lapsed", "event_time"])


STAR_ORDERS = StarOrders(
    "star_orders", "transactional_marketplace", 180,
    ("purchase", "monetary", "inactivity", "review", "delivery", "payment", "cadence"),
    hard_checks=True)
STAR_SHIPMENTS = StarShipments(
    "star_shipments", "transactional_marketplace", 180, COMMON, "user_disjoint")
STAR_CLICKS = StarClicks(
    "star_clicks", "clickstream_commerce", 1,
    ("purchase", "monetary", "inactivity", "engagement", "cadence"))
STAR_SUBSCRIBERS = StarSubscribers(
    "star_subscribers", "subscription", None, COMMON, "native", native_label=True)
# Column groups of the subscriber matrix, for ablation.
SUBSCRIBER_GROUPS = {"balance": ("balance",), "name": ("name_length",), "segment": ("segment_",)}
