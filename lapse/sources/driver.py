"""The star-schema tables (orders, lineitem, events, ...) mapped onto the standard event schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators import order_stats as O
from lapse.settings import ENGAGEMENT_WEIGHTS

# Explicit schemas: no inference pass, and times load as instants so that filters push down.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, "
              "props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}

CLICK_TYPES = {
    "view": "view", "click": "cart_add", "signup": "wishlist", "purchase": "purchase",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(os.path.join(folder, f"{name}.parquet"))


# Above every BIGINT, so line number and part stay apart in one DECIMAL(38, 0).
_PART_SPAN = 10**19


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per order: item count, first product, first ship date. Combined before any join.

    Line number and part are packed into one number: a minimum over numbers aggregates by hash,
    one over structs would sort.
    """
    items = table(spark, folder, "lineitem")
    span = F.lit(str(_PART_SPAN)).cast("decimal(20,0)")
    packed = (F.col("l_linenumber").cast("decimal(10,0)") * span + F.col("l_partkey")).cast("decimal(38,0)")
    facts = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.min(packed).alias("_packed"),
        F.min("l_shipdate").alias("first_ship"),
    )
    return facts.select(
        "o_orderkey", "item_count", F.pmod("_packed", span).cast("long").alias("product_id"),
        "first_ship")


def market_events(spark: SparkSession, folder: str, with_items: bool = True) -> DataFrame:
    """Orders as purchase events; item facts are joined only when a caller needs them."""
    orders = table(spark, folder, "orders")
    base = [
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("event_time"),
        F.lit("purchase").alias("event_type"),
        F.col("o_totalprice").alias("transaction_value"),
        F.col("o_orderpriority").alias("payment_type"),
    ]
    if not with_items:
        return orders.select(*base, F.col("o_orderkey").alias("product_id"))
    joined = orders.join(order_items(spark, folder), "o_orderkey", "left")
    delay = tm.floor_days("first_ship", "o_orderdate").cast("double")
    return joined.select(
        *base,
        "product_id",
        # Items per order stand in for a 1-5 rating; an order without items has none (0).
        F.coalesce(F.least(F.col("item_count"), F.lit(5)), F.lit(0)).cast("double")
        .alias("review_score"),
        F.coalesce(delay, F.lit(0.0)).alias("delivery_delay"),
    )


def map_clicks(events: DataFrame) -> DataFrame:
    """Raw stream rows on the shared vocabulary, with sessions and engagement weights."""
    mapped = events.select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_time"),
        S.lookup("event_type", CLICK_TYPES, "other").alias("event_type"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
        .alias("transaction_value"),
        F.get_json_object("props", "$.k").alias("session_id"),
        F.col("event_id").alias("product_id"),
    )
    return mapped.withColumn(
        "engagement_signal", S.lookup("event_type", ENGAGEMENT_WEIGHTS, 0.0)
    )


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    return map_clicks(table(spark, folder, "events"))


def listening_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a listening history: type is the artist, the property the track."""
    events = table(spark, folder, "events")
    return events.select(
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("product_id"),
        F.get_json_object("props", "$.k").alias("track_name"),
        F.lit("listen").alias("event_type"),
        F.lit(0.0).alias("transaction_value"),
    )


def shipment_events(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as events of their order: a stream with late-arriving entities."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("customer_id"),
        F.col("l_shipdate").alias("event_time"),
        F.lit("purchase").alias("event_type"),
        F.col("l_extendedprice").alias("transaction_value"),
        F.col("l_partkey").alias("product_id"),
    )


def numbered_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of each customer with their number and the days since the previous one."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("event_time"), F.col("o_totalprice").alias("transaction_value"),
    )
    groups = O.slice_groups(orders, ["customer_id"], "event_time", ["order_id"])
    linked = O.add_previous(O.add_positions(groups, "order_number"), "event_time", "_before")
    return linked.done().select(
        "customer_id", "order_id", "event_time", "transaction_value",
        F.lit("purchase").alias("event_type"), "order_number",
        tm.floor_days("event_time", "_before").cast("double").alias("days_since_prior_order"),
    )


def subscribers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a native label: a negative balance means lapsed."""
    customers = table(spark, folder, "customer")
    return customers.select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") < 0, "Yes").otherwise("No").alias("Lapsed"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.length("c_name").alias("name_length"),
        (F.abs("c_acctbal") / 1000).alias("balance"),
    )


def document_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions without a model: the label is toxicity, the score grows with the text length."""
    labels = table(spark, folder, "labels")
    documents = table(spark, folder, "documents").select("doc_id", "n_chars")
    p = F.least(F.lit(1.0), F.col("n_chars") / F.lit(20000.0))
    return labels.join(documents, "doc_id").select(
        F.lit("length").alias("model"), F.col("doc_id").alias("customer_id"),
        F.col("toxic").alias("y"), p.alias("p"),
        F.when(p >= 0.5, 1).otherwise(0).alias("yhat"),
        "quality", "n_chars",
    )
