"""Validation layers and gates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import checks as V
from lapse.operators import labels as L
from lapse.operators import metrics as M
from lapse.plans import gates, probe
from lapse.plans.driver import sql as Q
from lapse.plans.driver.labelling import COHORTS
from lapse.plans.driver.registry import query
from lapse.sources import driver as D
from lapse.sources import driver_adapters as DA
from lapse.sources import sinks as K


@query("V1 G22", f"""
WITH {Q.CLICK.strip()},
k AS (SELECT count(*) AS n, count(DISTINCT customer_id) AS c, floor((max(t) - min(t)) / {Q.DAY}.0) AS span,
  count(*) FILTER (WHERE session_id IS NULL) * 100.0 / count(*) AS no_session FROM click)
SELECT 'rows' AS "check", 'all' AS subject, 'ok' AS level, n::DOUBLE AS value FROM k
UNION ALL SELECT 'null_times', 'event_time', 'ok', 0 FROM k
UNION ALL SELECT 'null_ids', 'customer_id', 'ok', 0 FROM k
UNION ALL SELECT 'time_span_days', 'event_time', 'ok', span FROM k
UNION ALL SELECT 'unique_customers', 'customer_id', 'ok', c FROM k
UNION ALL SELECT 'duplicate_rows', 'all', 'ok', 0 FROM k
UNION ALL SELECT 'null_percent', 'session_id', 'ok', no_session FROM k
UNION ALL SELECT 'optional_column', 'review_score', 'info', NULL FROM k
UNION ALL SELECT 'feature_group', 'review', 'info', NULL FROM k
UNION ALL SELECT 'feature_group', 'engagement', 'ok', NULL FROM k""")
def schema_report(spark, sf):
    events = D.click_events(spark, sf)
    report = V.schema_report(events, "star_clicks", DA.STAR_CLICKS.feature_groups(events))
    wanted = (
        F.col("check").isin("rows", "null_times", "null_ids", "time_span_days",
                            "unique_customers", "duplicate_rows")
        | F.concat_ws(":", "check", "subject").isin(
            "null_percent:session_id", "optional_column:review_score", "feature_group:review",
            "feature_group:engagement")
    )
    return report.where(wanted).drop("dataset")


@query("V2 W1", f"""
WITH {Q.CLICK.strip()}, {Q.cutoffs('click', 1).strip()}, {Q.points().strip()}, {Q.labels('click', 1).strip()},
o AS (SELECT customer_id, count(*) AS n FROM click WHERE kind = 'purchase' GROUP BY 1),
g AS (SELECT floor((t - lag(t) OVER (PARTITION BY customer_id ORDER BY t)) / {Q.DAY}.0) AS d FROM click),
l AS (SELECT * FROM labelled WHERE point = 'train'),
vals AS (
  SELECT 'n_customers' AS "check", count(DISTINCT customer_id)::DOUBLE AS value FROM click
  UNION ALL SELECT 'n_events', count(*) FROM click
  UNION ALL SELECT 'time_span_days', floor((max(t) - min(t)) / {Q.DAY}.0) FROM click
  UNION ALL SELECT 'lapse_rate', avg(lapsed) FROM l
  UNION ALL SELECT 'n_lapsed', sum(lapsed) FROM l
  UNION ALL SELECT 'n_retained', count(*) - sum(lapsed) FROM l
  UNION ALL SELECT 'imbalance_ratio', (count(*) - sum(lapsed)) / sum(lapsed) FROM l
  UNION ALL SELECT 'avg_orders_per_customer', round(avg(n), 2) FROM o
  UNION ALL SELECT 'median_orders_per_customer', median(n) FROM o
  UNION ALL SELECT 'repeat_purchase_ratio', avg((n > 1)::INT) FROM o
  UNION ALL SELECT 'median_interpurchase_days', round(median(d), 1) FROM g WHERE d IS NOT NULL
  UNION ALL SELECT 'mean_interpurchase_days', round(avg(d), 1) FROM g WHERE d IS NOT NULL)
SELECT "check", value, CASE
  WHEN "check" = 'n_customers' AND value < 100 THEN 'warning'
  WHEN "check" = 'lapse_rate' AND value > 0.99 THEN 'critical'
  WHEN "check" = 'imbalance_ratio' AND value > 100 THEN 'warning'
  WHEN "check" = 'avg_orders_per_customer' AND value < 1.05 THEN 'warning'
  WHEN "check" = 'repeat_purchase_ratio' AND value < 0.01 THEN 'warning' ELSE 'ok' END AS level FROM vals""")
def behaviour_report(spark, sf):
    events = D.click_events(spark, sf)
    cut = L.global_cutoffs(events, 1)
    labels = L.inactivity_labels(events, cut.train, 1)
    report = V.behaviour_report(events, labels, "star_clicks")
    return report.where(~F.col("check").startswith("time_start") & ~F.col("check").startswith("time_end")
                        ).select("check", "value", "level")


_BY_LANG = f"""{Q.SCORES.strip()},
g AS (SELECT d.lang AS model, p.y, p.p FROM pred p JOIN documents d ON d.doc_id = p.customer_id)"""


def _by_language(spark, sf):
    lang = D.table(spark, sf, "documents").select(F.col("doc_id").alias("customer_id"), "lang")
    scored = D.document_scores(spark, sf).drop("model").join(lang, "customer_id")
    return scored.withColumnRenamed("lang", "model")


@query("V3", f"""
WITH {_BY_LANG}
SELECT model AS subject, 'constant_probabilities' AS "check" FROM g GROUP BY 1 HAVING min(p) = max(p)
UNION ALL SELECT model || ':roc_auc', 'null_metric' FROM g GROUP BY model HAVING sum(y) = 0 OR sum(y) = count(*)
UNION ALL SELECT model || ':avg_precision', 'null_metric' FROM g GROUP BY model HAVING sum(y) = 0
UNION ALL SELECT model || ':broken', 'null_probabilities' FROM g GROUP BY model HAVING count(*) FILTER (WHERE p >= 0.5) > 0
  AND count(*) FILTER (WHERE p < 0.5) > 0""")
def output_report(spark, sf):
    """Null metrics and unusable score columns per language, with a copy whose high scores are lost."""
    pred = _by_language(spark, sf)
    broken = pred.withColumn("model", F.concat("model", F.lit(":broken"))).withColumn(
        "p", F.when(F.col("p") < 0.5, F.col("p")))
    metrics = V.metric_report(M.evaluate(pred), "star").where(F.col("check") != "high_auc")
    scores = V.probability_report(pred, "star").unionByName(
        V.probability_report(broken, "star").where(F.col("check") == "null_probabilities"))
    return metrics.unionByName(scores).select("subject", "check")


def _master(spark, sf):
    """Results-like rows per market segment and nation group, from customer balances."""
    c = D.table(spark, sf, "customer")
    rate = F.avg(F.when(F.col("c_acctbal") < 0, 1.0).otherwise(0.0))
    table = c.groupBy("c_mktsegment", (F.col("c_nationkey") % 5).alias("k")).agg(
        (F.avg("c_acctbal") / 5000).alias("auc"), rate.alias("rate"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("k") == 4, F.lit(None).cast("double")).otherwise(F.col("auc"))
    return table.select(
        F.col("c_mktsegment").alias("dataset"), F.lit("x").alias("ecosystem_type"),
        F.concat(F.lit("m"), "k").alias("model"), value.alias("roc_auc"), value.alias("pr_auc"),
        F.col("rate").alias("f1"), F.col("rate").alias("precision"), F.col("rate").alias("recall"),
        F.col("rate").alias("brier_score"), (F.col("rate") * 3).alias("calibration_error"),
        F.col("rate").alias("lapse_rate"), F.lit(1.0).alias("imbalance_ratio"),
        F.lit("purchase").alias("dominant_feature_group"))


_MASTER = """
m AS (SELECT c_mktsegment AS dataset, 'm' || (c_nationkey % 5) AS model,
  CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE avg(c_acctbal) / 5000 END AS auc,
  avg((c_acctbal < 0)::INT) AS rate FROM customer GROUP BY c_mktsegment, c_nationkey % 5),
d AS (SELECT dataset, max(auc) AS auc, max(rate * 3) AS ece, max(rate) AS rate FROM m GROUP BY 1)"""


@query("V4", f"""
WITH {_MASTER.strip()}
SELECT dataset, 'auc_too_high' AS flag, round(auc, 9) AS value FROM d WHERE auc > 0.98
UNION ALL SELECT dataset, 'auc_too_low', round(auc, 9) FROM d WHERE auc < 0.45
UNION ALL SELECT dataset, 'poor_calibration', round(ece, 9) FROM d WHERE ece > 0.25
UNION ALL SELECT dataset, 'extreme_lapse_rate', round(rate, 9) FROM d WHERE rate > 0.99""")
def cross_dataset_flags(spark, sf):
    flags = V.cross_dataset_report(_master(spark, sf))
    return flags.withColumn("value", F.round("value", 9))


@query("V5", f"""
WITH {_MASTER.strip()}
SELECT 'warning' AS level, 'null_critical:roc_auc' AS "check", dataset, model FROM m WHERE auc IS NULL
UNION ALL SELECT 'warning', 'unknown_dataset', dataset, model FROM m WHERE dataset = 'MACHINERY'
UNION ALL SELECT 'warning', 'overwrites_entry', dataset, model FROM m WHERE dataset = 'BUILDING'""")
def master_entry_warnings(spark, sf):
    rows = _master(spark, sf)
    existing = rows.where(F.col("dataset") == "BUILDING")
    known = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    return V.master_entry_report(rows, known, existing)


@query("K7 V5", f"""
WITH {_MASTER.strip()}
SELECT dataset, model, round(rate, 9) AS f1 FROM m WHERE dataset <> 'BUILDING'
UNION ALL SELECT dataset, model, round(rate + 1, 9) FROM m WHERE dataset = 'BUILDING'""")
def upserted_master(spark, sf):
    """The master table after one dataset's rows were replaced."""
    import uuid

    from lapse.session import shared_dir

    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    scope = K.RunScope(root, "star")
    rows = _master(spark, sf)
    known = [r[0] for r in rows.select("dataset").distinct().collect()]
    K.upsert_master(scope, rows, known)
    again = rows.where(F.col("dataset") == "BUILDING").withColumn("f1", F.col("f1") + 1)
    K.upsert_master(scope, again, known)
    return K.read_table(spark, scope.master).select("dataset", "model", F.round("f1", 9).alias("f1"))


@query("V7", f"""
WITH {COHORTS.strip()},
r AS (SELECT count(*) AS n, count(*) FILTER (WHERE cohort = 'train') AS tr, count(*) FILTER (WHERE cohort = 'test') AS te,
  count(*) FILTER (WHERE cohort = 'excluded') AS ex,
  coalesce(sum(history_events) FILTER (WHERE cohort = 'train'), 0)::BIGINT AS tre,
  coalesce(sum(history_events) FILTER (WHERE cohort = 'test'), 0)::BIGINT AS tee,
  coalesce(sum(label_events) FILTER (WHERE cohort = 'train'), 0)::BIGINT AS trl,
  coalesce(sum(label_events) FILTER (WHERE cohort = 'test'), 0)::BIGINT AS tel,
  avg(lapsed) FILTER (WHERE cohort = 'train') AS trr, avg(lapsed) FILTER (WHERE cohort = 'test') AS ter,
  any_value(c) AS c, any_value(b) AS b FROM cohorts),
e AS (
  SELECT 'raw_users' AS "check", true AS ok, n || ' users' AS details FROM r
  UNION ALL SELECT 'train_users', true, printf('%d users (%.1f%%)', tr, 100 * (tr / n)) FROM r
  UNION ALL SELECT 'test_users', true, printf('%d users (%.1f%%)', te, 100 * (te / n)) FROM r
  UNION ALL SELECT 'excluded_users', true, printf('%d users (%.1f%%)', ex, 100 * (ex / n)) FROM r
  UNION ALL SELECT 'train_cutoff', true, strftime(make_timestamp(c::BIGINT), '%Y-%m-%d %H:%M:%S') FROM r
  UNION ALL SELECT 'test_snapshot', true, strftime(make_timestamp(b::BIGINT), '%Y-%m-%d %H:%M:%S') FROM r
  UNION ALL SELECT 'train_events', true, tre || ' before the cutoff' FROM r
  UNION ALL SELECT 'test_events', true, tee || ' before the snapshot' FROM r
  UNION ALL SELECT 'train_label_events', true, trl || ' inside the window' FROM r
  UNION ALL SELECT 'test_label_events', true, tel || ' inside the window' FROM r
  UNION ALL SELECT 'lapse_train', trr > 0 AND trr < 1, coalesce(printf('%.2f%%', 100 * trr), 'none') FROM r
  UNION ALL SELECT 'lapse_test', ter > 0 AND ter < 1, coalesce(printf('%.2f%%', 100 * ter), 'none') FROM r
  UNION ALL SELECT 'zero_user_overlap', true, '0 shared users' FROM r
  UNION ALL SELECT 'feature_matrices', tr >= 100 AND te >= 50 AND trr > 0 AND trr < 1 AND ter > 0 AND ter < 1,
    printf('train (%d, 3), test (%d, 3)', tr, te) FROM r)
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, details FROM e""")
def cohort_gate(spark, sf):
    report = gates.cohort_gate(D.shipment_events(spark, sf), "star_shipments", 180, ["purchase"])
    return report.select("check", "status", "details")


@query("V9", f"""
WITH {Q.CLICK.strip()}, {Q.cutoffs('click', 1).strip()},
k AS (SELECT floor((max(t) - min(t)) / {Q.DAY}.0)::BIGINT AS span FROM click),
m AS (SELECT string_agg(chr(39) || w || chr(39), ', ' ORDER BY w) AS missing
  FROM (VALUES ('view'), ('cart_add'), ('purchase')) AS t(w) WHERE w NOT IN (SELECT kind FROM click)),
e AS (
  SELECT 'data_span' AS "check", span > 0 AS ok, span || ' days' AS details FROM k
  UNION ALL SELECT 'train_label_window_observed', last_us >= train_us + {Q.DAY},
    'cutoff ' || strftime(make_timestamp(train_us::BIGINT), '%Y-%m-%d') || ' + 1 d' FROM cut
  UNION ALL SELECT 'test_label_window_observed', last_us >= test_us + {Q.DAY},
    'cutoff ' || strftime(make_timestamp(test_us::BIGINT), '%Y-%m-%d') || ' + 1 d' FROM cut
  UNION ALL SELECT 'label_window', false, 'configured 1 days' FROM cut
  UNION ALL SELECT 'event_type_coverage', missing IS NULL,
    'missing ' || coalesce('[' || missing || ']', 'none') FROM m
  UNION ALL SELECT 'native_label_columns_absent', true, 'leaked none' FROM cut
  UNION ALL SELECT 'uses_native_label', true, 'False' FROM cut)
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, details FROM e""")
def temporal_gate(spark, sf):
    """The one-day window of this stream is not the expected 90 days, so that check fails."""
    report = gates.temporal_gate(D.click_events(spark, sf), "star_clicks", 1)
    return report.select("check", "status", "details")


@query("V8", """
WITH k AS (SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_acctbal < 0) AS classes,
  bool_or(c_acctbal < 0) AS lapsed FROM customer),
e AS (
  SELECT 'group:balance' AS "check", true AS ok, printf('1 of %d columns removed', segments + 3) AS details FROM k
  UNION ALL SELECT 'group:name', true, printf('1 of %d columns removed', segments + 3) FROM k
  UNION ALL SELECT 'group:segment', true, printf('%d of %d columns removed', segments, segments + 3) FROM k
  UNION ALL SELECT 'coverage', true,
    printf('%d/%d (%.1f%%)', segments + 2, segments + 3, 100.0 * (segments + 2) / (segments + 3)) FROM k
  UNION ALL SELECT 'label_both_classes', classes = 2, 'classes ' || CASE WHEN classes = 2 THEN '[0, 1]'
    WHEN lapsed THEN '[1]' ELSE '[0]' END FROM k)
SELECT "check", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status, details FROM e""")
def ablation_gate(spark, sf):
    data = DA.STAR_SUBSCRIBERS.split(DA.STAR_SUBSCRIBERS.events(spark, sf))
    report = gates.ablation_gate(data.train, "star_subscribers", DA.SUBSCRIBER_GROUPS)
    return report.select("check", "status", "details")


@query("V10", """
WITH c AS (SELECT c_acctbal < 0 AS y, count(*) AS n FROM customer GROUP BY 1),
train AS (SELECT y, n - round((1 - 0.7::DOUBLE) * n)::BIGINT AS n FROM c),
kept AS (SELECT y, n - floor(0.1::DOUBLE * n + 0.5)::BIGINT AS n FROM train)
SELECT 'train_only_placement:train' AS "check", 'PASS' AS status, (max(n) - min(n)) || ' synthetic rows' AS details FROM kept
UNION ALL SELECT 'train_only_placement:' || fold, 'PASS', '0 synthetic rows'
FROM (VALUES ('validation'), ('test')) AS t(fold) WHERE EXISTS (SELECT 1 FROM customer)""")
def smote_gate(spark, sf):
    data = DA.STAR_SUBSCRIBERS.split(DA.STAR_SUBSCRIBERS.events(spark, sf))
    report = gates.smote_gate("star_subscribers", data.train, data.test)
    return report.select("check", "status", "details")


@query("V11 A7")
def dataset_probe(spark, sf):
    """One report row over the event stream; it holds a duration, so it has no SQL twin."""
    return probe.sanity_probe(spark, DA.STAR_CLICKS, sf, sample_customers=None)


def _stamp(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S')"


@query("V11 A7", f"""
WITH {Q.CLICK.strip()}, {Q.cutoffs('click', 1).strip()}, {Q.points().strip()}, {Q.labels('click', 1).strip()},
span AS (SELECT count(*) AS n, min(t) AS a, max(t) AS z FROM click),
side AS (SELECT point, count(*) AS n, avg(lapsed) AS rate FROM labelled GROUP BY 1)
SELECT 'star_clicks' AS dataset, span.n AS n_events_raw, span.n AS n_events_preprocessed, {_stamp('a')} AS first_event,
  {_stamp('z')} AS last_event, ((z - a) // {Q.DAY})::BIGINT AS span_days, {_stamp('train_us')} AS train_cutoff, {_stamp('test_us')} AS test_cutoff,
  last_us >= train_us + {Q.DAY} AS train_label_window_observed, last_us >= test_us + {Q.DAY} AS test_label_window_observed,
  round((SELECT rate FROM side WHERE point = 'train'), 9) AS lapse_rate_train,
  round((SELECT rate FROM side WHERE point = 'test'), 9) AS lapse_rate_test,
  (SELECT n FROM side WHERE point = 'train') AS n_train_customers, (SELECT n FROM side WHERE point = 'test') AS n_test_customers,
  (SELECT n FROM side WHERE point = 'train') AS sample_rows_train, (SELECT n FROM side WHERE point = 'test') AS sample_rows_test
FROM span, cut""")
def dataset_probe_facts(spark, sf):
    """The probe's counts, dates, cutoffs and rates."""
    report = probe.sanity_probe(spark, DA.STAR_CLICKS, sf, sample_customers=None)
    return report.select(
        "dataset", "n_events_raw", "n_events_preprocessed", "first_event", "last_event", "span_days", "train_cutoff", "test_cutoff",
        "train_label_window_observed", "test_label_window_observed", F.round("lapse_rate_train", 9).alias("lapse_rate_train"),
        F.round("lapse_rate_test", 9).alias("lapse_rate_test"), "n_train_customers", "n_test_customers", "sample_rows_train",
        "sample_rows_test")
