"""Scan, cleaning, encoding and join operators on the driver tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators import clean as C
from lapse.operators import combine as J
from lapse.operators import relative as R
from lapse.operators import splits
from lapse.plans.driver import sql as Q
from lapse.plans.driver.registry import query
from lapse.sources import driver as D


def _utc(y, m, d):
    return datetime(y, m, d, tzinfo=timezone.utc)


@query("P1 X2", """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS parsed_us,
       (epoch_us(ts) // 1000) * 1000 AS millis_us
FROM events""")
def parsed_times(spark, sf):
    """Text and epoch-millisecond parsing; unreadable text becomes null."""
    raw = D.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "no time")
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("text"),
        F.floor(F.unix_micros("ts") / 1000).cast("long").alias("ms"),
    )
    return raw.select(
        "event_id",
        F.unix_micros(tm.parse_instant("text", "dd/MM/yyyy HH:mm:ss")).alias("parsed_us"),
        F.unix_micros(tm.instant_from_millis("ms")).alias("millis_us"),
    )


@query("P2", """
SELECT count(*) FILTER (WHERE event_type <> 'error') AS kept,
       count(*) FILTER (WHERE event_type = 'error') AS dropped FROM events""")
def missing_rows_dropped(spark, sf):
    e = D.table(spark, sf, "events").withColumn(
        "actor", F.when(F.col("event_type") != "error", F.col("user_id"))
    )
    return C.dropped_rows(e, ["actor", "ts"])


@query("P3", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01'""")
def time_bounds(spark, sf):
    orders = D.table(spark, sf, "orders")
    return C.within_time(orders, "o_orderdate", _utc(1996, 1, 1), _utc(1999, 1, 1)).select(
        "o_orderkey", "o_custkey"
    )


@query("P4", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0")
def non_negative_values(spark, sf):
    return C.at_least(D.table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("P5 X7", """
WITH cap AS (SELECT quantile_cont(o_totalprice, 0.999) AS c FROM orders)
SELECT o_orderkey, round(CASE WHEN c > 0 THEN least(o_totalprice, c) ELSE o_totalprice END, 4) AS price
FROM orders, cap""")
def capped_prices(spark, sf):
    capped = C.cap_at_quantile(D.table(spark, sf, "orders"), "o_totalprice")
    return capped.select("o_orderkey", F.round("o_totalprice", 4).alias("price"))


@query("P6 P7 X9", f"""
WITH {Q.MARKET.strip()},
scored AS (SELECT o_orderkey, CASE WHEN item_count <= 5 THEN item_count::DOUBLE END AS rating,
                  item_count AS items
           FROM orders LEFT JOIN items ON o_orderkey = l_orderkey),
med AS (SELECT coalesce(median(rating), 5.0) AS m FROM scored)
SELECT o_orderkey, coalesce(rating, m) AS rating, coalesce(items, 0) AS items FROM scored, med""")
def imputed_values(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey")
    joined = J.left_lookup(orders, D.order_items(spark, sf), "o_orderkey")
    scored = joined.select(
        "o_orderkey",
        F.when(F.col("item_count") <= 5, F.col("item_count").cast("double")).alias("rating"),
        F.col("item_count").alias("items"),
    )
    return C.fill_zero(C.fill_median(scored, "rating"), ["items"])


@query("P8 X1", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT starts_with(trim(o_orderpriority), '4-')""")
def prefixed_rows_dropped(spark, sf):
    padded = D.table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit(" "), "o_orderpriority").alias("o_orderpriority")
    )
    return C.drop_prefixed(padded, "o_orderpriority", "4-")


@query("P9", """
SELECT event_id, coalesce(try_cast(CASE WHEN event_type = 'error' THEN 'n/a'
       ELSE json_extract_string(props, '$.k') END AS DOUBLE), 0) AS k FROM events""")
def coerced_numbers(spark, sf):
    raw = D.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.get_json_object("props", "$.k")).alias("k"),
    )
    return C.coerce_number(raw, "k")


@query("P10", """
SELECT trim(replace(c_name, 'Customer#', '  ')) AS id FROM customer
WHERE c_nationkey <> 0""")
def cleaned_ids(spark, sf):
    raw = D.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") == 0, "   ")
        .otherwise(F.replace("c_name", F.lit("Customer#"), F.lit("  "))).alias("id")
    )
    return C.clean_id(raw, "id")


@query("P11 P12 P13 P22 X10", """
WITH seg AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
             FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed, code AS segment_code,
       (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE AS "segment_AUTOMOBILE",
       (c_mktsegment = 'BUILDING')::INT::DOUBLE AS "segment_BUILDING",
       (c_mktsegment = 'FURNITURE')::INT::DOUBLE AS "segment_FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE AS "segment_HOUSEHOLD",
       (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS "segment_MACHINERY"
FROM customer JOIN seg USING (c_mktsegment)""")
def encoded_categories(spark, sf):
    """Label text, category codes and one-hot columns; the vocabulary is read from the data."""
    df = D.subscribers(spark, sf)
    values = C.category_values(df, "segment")
    coded = df.select(
        "customer_id", C.label_from_text("Lapsed", "Yes").alias("lapsed"), "segment",
        C.category_code("segment", values).cast("long").alias("segment_code"),
    )
    return C.one_hot(coded, "segment", values)


@query("P14 P15", f"""
WITH {Q.CLICK.strip()}
SELECT product_id AS event_id, kind AS event_type, signal AS engagement_signal FROM click""")
def mapped_vocabulary(spark, sf):
    return D.click_events(spark, sf).select(
        F.col("product_id").alias("event_id"), "event_type", "engagement_signal"
    )


@query("P16 J1 J4 A2", f"""
WITH {Q.MARKET.strip()}
SELECT customer_id, t AS event_us, 'purchase' AS event_type, value AS transaction_value,
       payment_type, product_id, review_score, delay AS delivery_delay FROM market""")
def standard_market_events(spark, sf):
    events = D.market_events(spark, sf)
    return events.withColumn("event_us", tm.micros("event_time")).drop("event_time")


@query("P17", """
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * l_extendedprice), 2) AS value
FROM lineitem GROUP BY 1""")
def line_values(spark, sf):
    items = D.table(spark, sf, "lineitem")
    return items.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(C.line_value("l_quantity", "l_extendedprice")), 2).alias("value"),
    )


@query("P18 X3 X4", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       floor((epoch_us(l_shipdate) - epoch_us(o_orderdate) - 1000000) / {Q.DAY}.0)::DOUBLE AS delay,
       (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000.0 AS seconds,
       strftime(o_orderdate, '%Y-%m-%d') AS ordered_on
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def delivery_delays(spark, sf):
    """One second before midnight already belongs to the previous day: days round down."""
    items = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_shipdate",
    )
    joined = items.join(D.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    early = F.timestamp_micros(F.unix_micros("l_shipdate") - 1000000)
    joined = joined.withColumn("arrived", early)
    return joined.select(
        F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
        C.delivery_delay("arrived", "o_orderdate").alias("delay"),
        tm.seconds_between("l_shipdate", "o_orderdate").alias("seconds"),
        F.to_date("o_orderdate").cast("string").alias("ordered_on"),
    )


@query("P19 W2", f"""
WITH {Q.NUMBERED.strip()}
SELECT order_id, sum(coalesce(gap, 0)) OVER (PARTITION BY customer_id)
       - sum(coalesce(gap, 0)) OVER (PARTITION BY customer_id ORDER BY order_number
                                     ROWS UNBOUNDED PRECEDING) AS days_from_end,
       strftime(TIMESTAMP '2017-03-21' - to_days((sum(coalesce(gap, 0)) OVER (PARTITION BY customer_id)
       - sum(coalesce(gap, 0)) OVER (PARTITION BY customer_id ORDER BY order_number
                                     ROWS UNBOUNDED PRECEDING))::INT), '%Y-%m-%d') AS placed_on
FROM numbered""")
def synthetic_order_times(spark, sf):
    placed = R.synthetic_timeline(
        D.numbered_orders(spark, sf).drop("event_time"), _utc(2017, 3, 21), key="customer_id"
    )
    return placed.select(
        "order_id", "days_from_end", F.to_date("event_time").cast("string").alias("placed_on")
    )


@query("P20 X5", """
SELECT c_custkey, strftime(TIMESTAMP '2019-01-31' - to_days(30 * c_nationkey), '%Y-%m-%d') AS started_on
FROM customer""")
def tenure_start_times(spark, sf):
    start = C.tenure_time("c_nationkey", _utc(2019, 1, 31))
    return D.table(spark, sf, "customer").select(
        "c_custkey", F.to_date(start).cast("string").alias("started_on")
    )


@query("P21 A3", """
WITH narrow AS (
  SELECT user_id, event_type,
         arg_max(value, epoch_us(ts)) AS value
  FROM events GROUP BY 1, 2)
SELECT user_id,
       max(CASE WHEN event_type = 'click' THEN value END) AS click,
       max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase,
       max(CASE WHEN event_type = 'signup' THEN value END) AS signup,
       max(CASE WHEN event_type = 'view' THEN value END) AS view
FROM narrow GROUP BY user_id""")
def property_table(spark, sf):
    """Latest value per (user, property), wide, without the constant column."""
    log = D.table(spark, sf, "events")
    wide = J.latest_properties_wide(log, "user_id", "event_type", "value", "ts")
    return C.narrow_columns(wide.withColumn("error", F.lit(1.0)), protected=["user_id"])


@query("P23", """
WITH a AS (SELECT o_custkey, o_orderdate, o_orderpriority FROM orders),
late AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
                count(*) AS orders FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1),
early AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low,
                 count(*) AS orders FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT 'test' AS side, o_custkey, orders, 0.0 AS low, urgent::DOUBLE AS urgent FROM late
UNION ALL SELECT 'train', o_custkey, orders, low::DOUBLE, 0.0 FROM early""")
def aligned_matrices(spark, sf):
    orders = D.table(spark, sf, "orders")
    border = tm.instant(_utc(2000, 1, 1))
    count = lambda c, v: S.count_where(F.col("o_orderpriority") == v).cast("double").alias(c)
    train = orders.where(F.col("o_orderdate") < border).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), count("low", "5-LOW"))
    test = orders.where(F.col("o_orderdate") >= border).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), count("urgent", "1-URGENT"))
    train, test = C.align_columns(train, test)
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test")))


@query("P24 P25", f"""
WITH {Q.CLICK.strip()}
SELECT customer_id, product_id, t AS event_us FROM click
WHERE t < epoch_us(TIMESTAMP '2024-01-20') AND kind IN ('purchase', 'transaction', 'order')""")
def purchase_history(spark, sf):
    past = C.history(D.click_events(spark, sf), _utc(2024, 1, 20))
    return C.purchases(past).select(
        "customer_id", "product_id", tm.micros("event_time").alias("event_us"))


# --------------------------------------------------------------------------------------- joins


@query("J2 W6", """
SELECT o_orderkey, arg_min(l_quantity, (epoch_us(l_shipdate)::HUGEINT * 1000 + l_quantity::INT)) AS score
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def first_review_per_order(spark, sf):
    """Earliest dated row per order, joined back; equal dates fall back to the smaller score."""
    reviews = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("review_creation_date"),
        F.col("l_quantity").alias("review_score"),
    )
    orders = D.table(spark, sf, "orders").select("o_orderkey")
    first = J.reduce_reviews(reviews, "o_orderkey")
    return J.left_lookup(orders, first, "o_orderkey").withColumnRenamed("review_score", "score")


@query("J3 A1", """
WITH typed AS (
  SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
modes AS (SELECT l_orderkey, l_returnflag AS payment_type FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS k FROM typed)
  WHERE k = 1),
sums AS (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS installments,
                round(sum(l_extendedprice), 2) AS value, count(*) AS payments
         FROM lineitem GROUP BY 1)
SELECT o_orderkey, installments, value, payment_type, payments
FROM orders LEFT JOIN sums ON o_orderkey = sums.l_orderkey
LEFT JOIN modes ON o_orderkey = modes.l_orderkey""")
def payments_per_order(spark, sf):
    payments = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
        F.col("l_extendedprice").alias("payment_value"),
    )
    reduced = J.reduce_payments(payments, "o_orderkey")
    joined = J.left_lookup(D.table(spark, sf, "orders").select("o_orderkey"), reduced, "o_orderkey")
    return joined.select(
        "o_orderkey", F.col("payment_installments").alias("installments"),
        F.round("payment_value", 2).alias("value"), "payment_type",
        F.col("payment_sequential_count").alias("payments"),
    )


@query("J4 A2", """
SELECT l_orderkey AS order_id,
       arg_min(l_partkey, l_linenumber::BIGINT * 10000000000 + l_partkey) AS product_id,
       round(sum(l_extendedprice), 2) AS price, round(sum(l_tax), 4) AS freight, count(*) AS item_count
FROM lineitem GROUP BY 1""")
def items_per_order(spark, sf):
    items = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("freight_value"),
    )
    out = J.reduce_items(items)
    return out.select("order_id", "product_id", F.round("price", 2).alias("price"),
                      F.round("freight_value", 4).alias("freight"), "item_count")


@query("J1 J5", """
SELECT o_orderkey, n_name, r_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""")
def dimension_chain(spark, sf):
    """Orders with customer, nation and region; Spark broadcasts a side when its size allows."""
    orders = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = D.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nations = D.table(spark, sf, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    out = J.left_lookup(orders, customers, "c_custkey")
    out = J.left_lookup(out, nations, "n_nationkey")
    out = J.left_lookup(out, D.table(spark, sf, "region"), "r_regionkey")
    return out.select("o_orderkey", "n_name", "r_name")


@query("J6 J7", """
WITH last AS (SELECT user_id, event_type, arg_max(value, epoch_us(ts)) AS v FROM events GROUP BY 1, 2),
wide AS (SELECT user_id,
  max(CASE WHEN event_type = 'click' THEN v END) AS last_click,
  max(CASE WHEN event_type = 'error' THEN v END) AS last_error,
  max(CASE WHEN event_type = 'purchase' THEN v END) AS last_purchase,
  max(CASE WHEN event_type = 'signup' THEN v END) AS last_signup,
  max(CASE WHEN event_type = 'view' THEN v END) AS last_view FROM last GROUP BY 1)
SELECT event_id, last_click, last_error, last_purchase, last_signup, last_view, c_mktsegment
FROM events LEFT JOIN wide USING (user_id) LEFT JOIN customer ON user_id = c_custkey""")
def enriched_events(spark, sf):
    """Events with the wide property table and the customer profile."""
    log = D.table(spark, sf, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    wide = J.latest_properties_wide(log, "user_id", "event_type", "value", "ts", kinds)
    wide = wide.withColumnsRenamed({k: f"last_{k}" for k in kinds})
    profile = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_mktsegment")
    out = J.left_lookup(J.left_lookup(log.select("event_id", "user_id"), wide, "user_id"),
                        profile, "user_id")
    return out.drop("user_id")


@query("J9", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def orders_of_listed_customers(spark, sf):
    listed = D.table(spark, sf, "customer").where("c_acctbal < 0").select(
        F.col("c_custkey").alias("o_custkey"))
    return J.semi(D.table(spark, sf, "orders"), listed, "o_custkey").select("o_orderkey")


@query("J10", """
SELECT event_id FROM events WHERE user_id IN (
  SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 60)
  AND user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 3)""")
def active_users_only(spark, sf):
    events = D.table(spark, sf, "events")
    busy = J.with_min_activity(events, "user_id", 60)
    return J.with_min_activity(busy, "user_id", 3, distinct="event_type").select("event_id")


@query("J11", f"""
WITH {Q.NUMBERED.strip()},
sized AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n FROM numbered)
SELECT order_id FROM sized WHERE order_number <= greatest(1, floor(n * 0.7::DOUBLE))""")
def observed_order_rows(spark, sf):
    """Semi join on (customer, order number) with the observed part of each history."""
    orders = D.numbered_orders(spark, sf)
    kept = R.history_split(orders, "customer_id", "order_number").where("observed").select(
        "customer_id", "order_number")
    return J.semi(orders, kept, ["customer_id", "order_number"]).select("order_id")


@query("J12", f"""
SELECT DISTINCT o_custkey AS customer_id FROM orders
WHERE epoch_us(o_orderdate) > epoch_us(TIMESTAMP '2000-01-01')
  AND epoch_us(o_orderdate) <= epoch_us(TIMESTAMP '2000-01-01') + 180 * {Q.DAY}""")
def customers_active_in_window(spark, sf):
    start = _utc(2000, 1, 1)
    window = F.col("o_orderdate") > tm.instant(start)
    window = window & (F.col("o_orderdate") <= tm.instant(tm.plus_days(start, 180)))
    return D.table(spark, sf, "orders").where(window).select(
        F.col("o_custkey").alias("customer_id")).distinct()


@query("J13 W10 W11", """
WITH a AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'),
b AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup')
SELECT 'both' AS side, id FROM a WHERE id IN (SELECT id FROM b)
UNION ALL SELECT 'first_only', id FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT 'neither', c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT id FROM a) AND c_custkey NOT IN (SELECT id FROM b)""")
def id_set_operations(spark, sf):
    events = D.table(spark, sf, "events").withColumnRenamed("user_id", "id")
    a = events.where(F.col("event_type") == "purchase")
    b = events.where(F.col("event_type") == "signup")
    everyone = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    rest = J.anti(J.anti(everyone, a.select("id"), "id"), b.select("id"), "id")
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "id")
    return tag(J.shared_values(a, b, "id"), "both").unionByName(
        tag(J.values_missing(a, b, "id"), "first_only")).unionByName(tag(rest, "neither"))


@query("S6 W9", """
SELECT o_orderstatus, count(*) AS n FROM (
  SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'
  UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
GROUP BY 1""")
def combined_sheets(spark, sf):
    """Two parts of a table read apart and put together by column name."""
    from lapse.sources.readers import union_parts

    orders = D.table(spark, sf, "orders")
    border = tm.instant(_utc(1998, 1, 1))
    first = orders.where(F.col("o_orderdate") < border).select("o_orderkey", "o_orderstatus")
    second = orders.where(F.col("o_orderdate") >= border).select("o_orderstatus", "o_orderkey")
    return union_parts([first, second]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("S7", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def trailing_columns_dropped(spark, sf):
    from lapse.sources.readers import drop_trailing

    return drop_trailing(D.table(spark, sf, "orders"), 2)


@query("S4", "SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem")
def projected_scan(spark, sf):
    items = D.table(spark, sf, "lineitem")
    return items.select("l_orderkey", F.to_date("l_shipdate").cast("string").alias("shipped"))


@query("S8", f"""
SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (
  ORDER BY {Q.stable_hash('o_orderkey', 'sample42')}) AS k FROM orders) WHERE k <= 5000""")
def seeded_sample(spark, sf):
    """A sampling operator: exactly n rows by stable hash."""
    return splits.sample_rows(
        D.table(spark, sf, "orders").select("o_orderkey"), 5000, ["o_orderkey"])


@query("X6 X8", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round_even(l_discount * 100 / 2, 0)::INT AS half_discount,
       coalesce(l_extendedprice / nullif(l_tax, 0), 0) AS guarded
FROM lineitem""")
def rounding_and_division(spark, sf):
    items = D.table(spark, sf, "lineitem")
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.half_even(F.col("l_discount") * 100 / 2).cast("int").alias("half_discount"),
        S.ratio("l_extendedprice", "l_tax").alias("guarded"),
    )



@query("W6", """
SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS shipped, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS LAST, l_linenumber, l_partkey) AS k
  FROM lineitem) WHERE k = 1""")
def first_line_per_order(spark, sf):
    """One row per key in a stated order."""
    items = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    first = J.keep_first(items, ["l_orderkey"], ["l_shipdate"])
    return first.select(
        "l_orderkey", F.to_date("l_shipdate").cast("string").alias("shipped"), "l_linenumber", "l_partkey")
