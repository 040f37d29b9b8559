"""Cutoffs, labels, cohorts and splits on the driver tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from lapse.operators import assemble as A
from lapse.operators import clean as C
from lapse.operators import labels as L
from lapse.operators import relative as R
from lapse.operators import splits
from lapse.operators.features import POINT
from lapse.plans.driver import sql as Q
from lapse.plans.driver.registry import query
from lapse.sources import driver as D

SHIPMENTS = """
ship AS (SELECT l_orderkey AS customer_id, epoch_us(l_shipdate) AS t FROM lineitem)"""

COHORTS = f"""{SHIPMENTS},
ends AS (SELECT max(t) - 180 * {Q.DAY} AS b, round(quantile_cont(t, 0.7))::BIGINT AS q FROM ship),
cut AS (SELECT least(q, b - 180 * {Q.DAY}) AS c, b FROM ends),
per AS (
  SELECT customer_id, min(t) AS first_us,
         count(*) FILTER (WHERE t < c) AS before_c, count(*) FILTER (WHERE t < b) AS before_b,
         count(*) FILTER (WHERE t > c) AS after_c, count(*) FILTER (WHERE t > b) AS after_b,
         count(*) FILTER (WHERE t > c AND t <= c + 180 * {Q.DAY}) AS in_c,
         count(*) FILTER (WHERE t > b AND t <= b + 180 * {Q.DAY}) AS in_b,
         any_value(c) AS c, any_value(b) AS b
  FROM ship, cut GROUP BY customer_id),
cohorts AS (
  SELECT customer_id,
         CASE WHEN first_us < c THEN 'train' WHEN first_us < b THEN 'test' ELSE 'excluded' END AS cohort,
         CASE WHEN first_us < c THEN before_c WHEN first_us < b THEN before_b END AS history_events,
         CASE WHEN first_us < c THEN in_c WHEN first_us < b THEN in_b END AS label_events,
         CASE WHEN first_us < c THEN after_c WHEN first_us < b THEN after_b END AS events_after,
         CASE WHEN first_us < c THEN (in_c = 0)::INT WHEN first_us < b THEN (in_b = 0)::INT END AS lapsed,
         c, b FROM per)"""


def _market(spark, sf):
    return D.market_events(spark, sf, with_items=False)


@query("L1", f"""
WITH {Q.MARKET.strip()}, {Q.CLICK.strip()}, {Q.cutoffs('market', 180).strip()},
{Q.cutoffs('click', 1, 'cut2').strip()}
SELECT 'orders' AS source, train_us, test_us FROM cut
UNION ALL SELECT 'events', train_us, test_us FROM cut2""")
def global_cutoffs(spark, sf):
    out = None
    for name, events, window in (
        ("orders", _market(spark, sf), 180), ("events", D.click_events(spark, sf), 1)
    ):
        cut = L.global_cutoffs(events, window).frame(spark).select(
            F.lit(name).alias("source"), F.unix_micros("train_cutoff").alias("train_us"),
            F.unix_micros("test_cutoff").alias("test_us"))
        out = cut if out is None else out.unionByName(cut)
    return out


@query("L2 J12", f"""
WITH {Q.MARKET.strip()}, {Q.cutoffs('market', 180).strip()}, {Q.points().strip()},
{Q.labels('market', 180).strip()}
SELECT customer_id, lapsed FROM labelled WHERE point = 'train'""")
def inactivity_labels(spark, sf):
    events = _market(spark, sf)
    cut = L.global_cutoffs(events, 180)
    return L.require_labels(L.inactivity_labels(events, cut.train, 180), cut.train)


@query("L2 L3 A5", f"""
WITH {Q.CLICK.strip()}, {Q.cutoffs('click', 1).strip()}, {Q.points().strip()},
{Q.labels('click', 1).strip()}
SELECT point, count(*) AS n_total, count(*) FILTER (WHERE lapsed = 1) AS n_pos,
       count(*) FILTER (WHERE lapsed = 0) AS n_neg, avg(lapsed) AS lapse_rate,
       CASE WHEN count(*) FILTER (WHERE lapsed = 1) = 0 THEN 'Infinity'::DOUBLE
            ELSE count(*) FILTER (WHERE lapsed = 0) / count(*) FILTER (WHERE lapsed = 1) END AS imbalance_ratio,
       avg(lapsed) < 0.01 OR avg(lapsed) > 0.99 AS extreme_rate
FROM labelled GROUP BY point""")
def label_summaries(spark, sf):
    events = D.click_events(spark, sf)
    cut = L.global_cutoffs(events, 1)
    points = [L.LabelPoint("train", cut.train, 1), L.LabelPoint("test", cut.test, 1)]
    return L.label_summary(L.labels_at(events, points), ["point"])


@query("L4 J13", f"""
WITH {COHORTS.strip()}
SELECT customer_id, cohort, history_events, label_events, events_after, lapsed FROM cohorts""")
def disjoint_cohorts(spark, sf):
    cohorts = L.disjoint_cohorts(D.shipment_events(spark, sf), 180)
    return cohorts.customers.drop("first_event")


@query("L4 L5 V7", f"""
WITH {COHORTS.strip()}
SELECT count(*) AS n_raw, count(*) FILTER (WHERE cohort = 'train') AS n_train,
  count(*) FILTER (WHERE cohort = 'test') AS n_test,
  count(*) FILTER (WHERE cohort = 'excluded') AS n_excluded,
  coalesce(sum(history_events) FILTER (WHERE cohort = 'train'), 0)::BIGINT AS train_events,
  coalesce(sum(history_events) FILTER (WHERE cohort = 'test'), 0)::BIGINT AS test_events,
  coalesce(sum(label_events) FILTER (WHERE cohort = 'train'), 0)::BIGINT AS train_label_events,
  coalesce(sum(label_events) FILTER (WHERE cohort = 'test'), 0)::BIGINT AS test_label_events,
  coalesce(sum(events_after) FILTER (WHERE cohort = 'train'), 0)::BIGINT AS train_events_after,
  coalesce(sum(events_after) FILTER (WHERE cohort = 'test'), 0)::BIGINT AS test_events_after,
  avg(lapsed) FILTER (WHERE cohort = 'train') AS lapse_train,
  avg(lapsed) FILTER (WHERE cohort = 'test') AS lapse_test,
  count(*) FILTER (WHERE cohort = 'train') / count(*) AS train_share,
  count(*) FILTER (WHERE cohort = 'test') / count(*) AS test_share,
  count(*) FILTER (WHERE cohort = 'excluded') / count(*) AS excluded_share,
  any_value(c) AS train_us, any_value(b) AS test_us
FROM cohorts""")
def cohort_summary(spark, sf):
    summary = L.cohort_summary(L.disjoint_cohorts(D.shipment_events(spark, sf), 180))
    return summary.withColumns({
        "train_us": F.unix_micros("train_cutoff"), "test_us": F.unix_micros("test_snapshot"),
    }).drop("train_cutoff", "test_snapshot")


@query("L5 J14 W10", f"""
WITH {COHORTS.strip()},
items AS (SELECT l_orderkey AS customer_id, epoch_us(l_shipdate) AS t, l_extendedprice AS value FROM lineitem),
per_time AS (
  SELECT k.customer_id, cohort, lapsed, t, sum(value) AS v, count(*) AS n
  FROM items i JOIN cohorts k ON i.customer_id = k.customer_id
  WHERE cohort <> 'excluded' AND t < CASE cohort WHEN 'train' THEN c ELSE b END
  GROUP BY ALL)
SELECT cohort AS point, customer_id, any_value(lapsed) AS lapsed, count(*)::DOUBLE AS total_orders,
       sum(n)::DOUBLE AS total_items_purchased, (count(*) > 1)::INT::DOUBLE AS repeat_purchase_ratio,
       round(sum(v), 2) AS total_spent
FROM per_time GROUP BY cohort, customer_id""")
def disjoint_modeling_table(spark, sf):
    events = D.shipment_events(spark, sf)
    cohorts = L.disjoint_cohorts(events, 180)
    table = A.disjoint_table(events, cohorts, ["purchase", "monetary"])
    return table.select(
        POINT, "customer_id", "lapsed", "total_orders", "total_items_purchased",
        "repeat_purchase_ratio", F.round("total_spent", 2).alias("total_spent"))


@query("L6 W3", f"""
WITH {Q.NUMBERED.strip()}
SELECT order_id, order_number <= greatest(1, floor(count(*) OVER (PARTITION BY customer_id) * 0.7::DOUBLE)) AS observed
FROM numbered""")
def history_split(spark, sf):
    split = R.history_split(D.numbered_orders(spark, sf), "customer_id", "order_number")
    return split.select("order_id", "observed")


CADENCE = f"""{Q.NUMBERED.strip()},
placed AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n FROM numbered),
means AS (
  SELECT customer_id,
         avg(nullif(gap, 0)) FILTER (WHERE order_number <= greatest(1, floor(n * 0.7::DOUBLE))) AS early,
         avg(nullif(gap, 0)) FILTER (WHERE order_number > greatest(1, floor(n * 0.7::DOUBLE))) AS late,
         max(order_number) FILTER (WHERE order_number <= greatest(1, floor(n * 0.7::DOUBLE))) AS last_observed
  FROM placed WHERE n >= 3 GROUP BY customer_id),
decay AS (SELECT customer_id, (late > 1.5 * early)::INT AS lapsed, last_observed FROM means
          WHERE early IS NOT NULL AND late IS NOT NULL)"""


@query("L7", f"WITH {CADENCE} SELECT * FROM decay")
def cadence_labels(spark, sf):
    return R.cadence_labels(D.numbered_orders(spark, sf))


@query("L7 J11", f"""
WITH {CADENCE},
kept AS (SELECT n.customer_id, lapsed, t, value FROM numbered n JOIN decay d
         ON n.customer_id = d.customer_id AND order_number <= last_observed),
snap AS (SELECT max(t) + {Q.DAY} AS s FROM kept),
per_time AS (SELECT customer_id, any_value(lapsed) AS lapsed, t, sum(value) AS v FROM kept GROUP BY customer_id, t)
SELECT customer_id, any_value(lapsed) AS lapsed, count(*)::DOUBLE AS total_orders,
       round(sum(v), 2) AS total_spent,
       floor((any_value(s) - max(t)) / {Q.DAY}.0)::DOUBLE AS days_since_last_purchase,
       floor((max(t) - min(t)) / {Q.DAY}.0)::DOUBLE AS customer_lifetime_days
FROM per_time, snap GROUP BY customer_id""")
def cadence_modeling_table(spark, sf):
    table = R.cadence_table(
        D.numbered_orders(spark, sf), ["purchase", "monetary", "inactivity", "cadence"])
    return table.select(
        "customer_id", "lapsed", "total_orders", F.round("total_spent", 2).alias("total_spent"),
        "days_since_last_purchase", "customer_lifetime_days")


@query("L8 A4 W3 W4", f"""
WITH placed AS (
  SELECT user_id AS customer_id, epoch_us(ts) AS t, event_type AS artist,
         json_extract_string(props, '$.k') AS track,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n,
         epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
parts AS (SELECT *, k <= greatest(1, floor(n * 0.7::DOUBLE)) AS early FROM placed WHERE n >= 50),
f AS (
  SELECT customer_id, count(*) FILTER (WHERE early) AS total, count(*) FILTER (WHERE NOT early) AS later,
    greatest(1, floor((max(t) FILTER (WHERE early) - min(t) FILTER (WHERE early)) / {Q.DAY}.0) + 1) AS d1,
    greatest(1, floor((max(t) FILTER (WHERE NOT early) - min(t) FILTER (WHERE NOT early)) / {Q.DAY}.0) + 1) AS d2,
    count(DISTINCT artist) FILTER (WHERE early) AS artists,
    count(DISTINCT track) FILTER (WHERE early) AS tracks,
    count(DISTINCT t // {Q.DAY}) FILTER (WHERE early) AS days,
    max(gap) FILTER (WHERE early) AS gap
  FROM parts GROUP BY customer_id)
SELECT customer_id, (later / d2 < 0.5 * (total / d1))::INT AS lapsed, total::DOUBLE AS total_listens,
       artists::DOUBLE AS unique_artists, tracks::DOUBLE AS unique_tracks, days::DOUBLE AS active_days,
       total / greatest(days, 1) AS avg_listens_per_day, 0.0::DOUBLE AS days_since_last_listen,
       round(coalesce(gap / {Q.DAY}.0::DOUBLE, 0.0), 6) AS max_gap_between_sessions,
       total / greatest(days, 1) AS listening_frequency, artists / greatest(total, 1) AS artist_diversity_ratio
FROM f WHERE later > 0""")
def listening_modeling_table(spark, sf):
    table = R.listening_table(D.listening_events(spark, sf))
    gap = "max_gap_between_sessions"
    return table.withColumn(gap, F.round(gap, 6))


def _native(spark, sf):
    df = D.subscribers(spark, sf)
    labelled = df.withColumn("lapsed", C.label_from_text("Lapsed", "Yes"))
    coded = C.one_hot(labelled, "segment")
    predictors = C.numeric_predictors(coded, exclude=["lapsed", "event_time"])
    return predictors, L.native_labels(labelled)


@query("L9", "SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed FROM customer")
def native_labels(spark, sf):
    return _native(spark, sf)[1]


@query("L10 P22", f"""
WITH keyed AS (
  SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed, c_mktsegment, c_nationkey, c_name, c_acctbal,
         {Q.stable_hash('c_custkey', 'native42')} AS h FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lapsed ORDER BY h) AS k,
                  count(*) OVER (PARTITION BY lapsed) AS n FROM keyed)
SELECT CASE WHEN k <= round((1 - 0.7::DOUBLE) * n) THEN 'test' ELSE 'train' END AS side, customer_id, lapsed,
       c_nationkey::DOUBLE AS nation, length(c_name)::DOUBLE AS name_length, abs(c_acctbal) / 1000 AS balance,
       (c_mktsegment = 'AUTOMOBILE')::INT::DOUBLE AS "segment_AUTOMOBILE",
       (c_mktsegment = 'BUILDING')::INT::DOUBLE AS "segment_BUILDING",
       (c_mktsegment = 'FURNITURE')::INT::DOUBLE AS "segment_FURNITURE",
       (c_mktsegment = 'HOUSEHOLD')::INT::DOUBLE AS "segment_HOUSEHOLD",
       (c_mktsegment = 'MACHINERY')::INT::DOUBLE AS "segment_MACHINERY" FROM ranked""")
def stratified_split(spark, sf):
    data = A.native_split(*_native(spark, sf))
    both = data.train.withColumn("side", F.lit("train")).unionByName(
        data.test.withColumn("side", F.lit("test")))
    return both.select("side", "customer_id", "lapsed", "nation", "name_length", "balance",
                       *sorted(c for c in both.columns if c.startswith("segment_")))


@query("L13", f"""
WITH keyed AS (
  SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed,
         {Q.stable_hash('c_custkey', 'cap42')} AS h FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lapsed ORDER BY h) AS k,
                  count(*) OVER (PARTITION BY lapsed) AS n, count(*) OVER () AS total FROM keyed)
SELECT customer_id, lapsed FROM ranked
WHERE k <= CASE WHEN total <= 1000 THEN n ELSE greatest(1, round(n * 1000 / total)) END""")
def stratified_row_cap(spark, sf):
    """The optional sampling operator in front of the SVM fit."""
    return splits.stratified_cap(_native(spark, sf)[1], 1000)


@query("T12", f"""
WITH keyed AS (
  SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed,
         {Q.stable_hash('c_custkey', 'fold42')} AS h FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lapsed ORDER BY h) AS k,
                  count(*) OVER (PARTITION BY lapsed) AS n FROM keyed)
SELECT customer_id, lapsed, (k > n * 1 // 3)::INT + (k > n * 2 // 3)::INT AS fold FROM ranked""")
def stratified_folds(spark, sf):
    return splits.with_folds(_native(spark, sf)[1], 3)


@query("L11", f"""
WITH c AS (SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed,
                  epoch_us(TIMESTAMP '2019-01-31' - to_days(30 * c_nationkey)) AS t,
                  abs(c_acctbal) AS value FROM customer),
pts AS (SELECT 'train' AS point, round(quantile_cont(t, 0.7))::BIGINT AS s FROM c
        UNION ALL SELECT 'test', max(t) FROM c)
SELECT point, customer_id, any_value(lapsed) AS lapsed, 1.0::DOUBLE AS total_orders,
       round(sum(value), 4) AS total_spent,
       floor((any_value(s) - max(t)) / {Q.DAY}.0)::DOUBLE AS days_since_last_purchase
FROM c, pts WHERE t < s GROUP BY point, customer_id""")
def native_snapshot_table(spark, sf):
    """Native labels on a synthetic timeline: snapshots at the time quantile and at the end."""
    anchor = datetime(2019, 1, 31, tzinfo=timezone.utc)
    events = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        C.tenure_time("c_nationkey", anchor).alias("event_time"),
        F.abs("c_acctbal").alias("transaction_value"))
    data = A.native_snapshot_split(
        events, _native(spark, sf)[1], groups=["purchase", "monetary", "inactivity"])
    both = data.train.withColumn(POINT, F.lit("train")).unionByName(
        data.test.withColumn(POINT, F.lit("test")))
    return both.select(POINT, "customer_id", "lapsed", "total_orders",
                       F.round("total_spent", 4).alias("total_spent"), "days_since_last_purchase")


@query("L12", f"""
WITH {Q.MARKET.strip()}, {Q.cutoffs('market', 180).strip()}
SELECT 'train_label_window_observed' AS "check", last_us >= train_us + 180 * {Q.DAY} AS passed FROM cut
UNION ALL SELECT 'test_label_window_observed', last_us >= test_us + 180 * {Q.DAY} FROM cut
UNION ALL SELECT 'no_target_columns', true
UNION ALL SELECT 'cutoff_order', train_us < test_us FROM cut
UNION ALL SELECT 'labels_binary', true""")
def temporal_validity(spark, sf):
    events = _market(spark, sf)
    cut = L.global_cutoffs(events, 180)
    points = [L.LabelPoint("train", cut.train, 180), L.LabelPoint("test", cut.test, 180)]
    labels = L.labels_at(events, points)
    return L.temporal_checks(events, cut, labels, ["total_orders"]).select("check", "passed")


@query("T15 L1 L2", f"""
WITH {Q.MARKET.strip()}, {Q.cutoffs('market', 90, 'c90').strip()},
{Q.cutoffs('market', 180, 'c180').strip()}, {Q.cutoffs('market', 270, 'c270').strip()},
pts AS (
  SELECT 90 AS w, train_us AS s, 'train' AS side FROM c90 UNION ALL SELECT 90, test_us, 'test' FROM c90
  UNION ALL SELECT 180, train_us, 'train' FROM c180 UNION ALL SELECT 180, test_us, 'test' FROM c180
  UNION ALL SELECT 270, train_us, 'train' FROM c270 UNION ALL SELECT 270, test_us, 'test' FROM c270),
lab AS (
  SELECT w, side, customer_id, CASE WHEN bool_or(t > s AND t <= s + w * {Q.DAY}) THEN 0 ELSE 1 END AS lapsed
  FROM market, pts GROUP BY w, side, customer_id HAVING min(t) < any_value(s))
SELECT w || ':' || side AS point, count(*) AS n_total, count(*) FILTER (WHERE lapsed = 1) AS n_pos,
       round(avg(lapsed), 4) AS lapse_rate FROM lab GROUP BY w, side""")
def window_label_rates(spark, sf):
    """Label rates of three windows and both cohorts from one aggregate over the events."""
    events = _market(spark, sf)
    points = []
    for cut in L.cutoffs_for_windows(events, [90, 180, 270]):
        points.append(L.LabelPoint(f"{cut.window_days}:train", cut.train, cut.window_days))
        points.append(L.LabelPoint(f"{cut.window_days}:test", cut.test, cut.window_days))
    summary = L.label_summary(L.labels_at(events, points), ["point"])
    return summary.select("point", "n_total", "n_pos", F.round("lapse_rate", 4).alias("lapse_rate"))


@query("W1 V2", f"""
WITH g AS (SELECT floor((epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate)) / {Q.DAY}.0) AS d FROM orders)
SELECT median(d) AS median_days, avg(d) AS mean_days FROM g WHERE d IS NOT NULL""")
def inter_event_gaps(spark, sf):
    return R.gap_summary(R.inter_event_days(_market(spark, sf)))


