"""Baselines, models, oversampling, segments, attributions and ablation on the driver tables, with the library's settings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.operators import ablation as AB
from lapse.operators import assemble as A
from lapse.operators import attribution as AT
from lapse.operators import metrics as M
from lapse.operators import models as ML
from lapse.operators import oversample as OS
from lapse.operators import profile as P
from lapse.operators import segments as SG
from lapse.operators.features import feature_columns
from lapse.plans import compare, sensitivity
from lapse.plans.driver import sql as Q
from lapse.plans.driver.registry import query
from lapse.plans.run import run_pipeline
from lapse.session import cut_lineage, materialise, shared_dir
from lapse.settings import Settings
from lapse.sources import driver as D
from lapse.sources import driver_adapters as DA

_SUBSCRIBERS = f"""
s AS (SELECT c_custkey AS customer_id, (c_acctbal < 0)::INT AS lapsed,
             {Q.stable_hash('c_custkey', 'native42')} AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY lapsed ORDER BY h) AS k, count(*) OVER (PARTITION BY lapsed) AS n FROM s),
split AS (SELECT customer_id, lapsed, k <= round((1 - 0.7::DOUBLE) * n) AS held FROM r)"""


def _subscribers(spark, sf):
    events = DA.STAR_SUBSCRIBERS.events(spark, sf)
    return DA.STAR_SUBSCRIBERS.split(events)


def _orders(spark, sf):
    events = DA.STAR_ORDERS.events(spark, sf)
    return DA.STAR_ORDERS.split(events)


def _shared_folder(spark) -> str:
    """Where a fitted ensemble is written so that tasks can read its nodes back."""
    return f"{shared_dir(spark)}/models/{uuid.uuid4().hex}"


@query("M8 M9 M6", f"""
WITH {_SUBSCRIBERS.strip()},
base AS (SELECT avg(lapsed) AS rate, (sum(lapsed) > count(*) - sum(lapsed))::INT AS top FROM split WHERE NOT held)
SELECT 'majority_class' AS model, customer_id, lapsed AS y, NULL::DOUBLE AS p, top AS yhat FROM split, base WHERE held
UNION ALL
SELECT 'random_baseline', customer_id, lapsed, rate,
       (({Q.stable_hash('customer_id', 'baseline42')}) / {float(16**15)!r}::DOUBLE < rate)::INT
FROM split, base WHERE held""")
def baseline_predictions(spark, sf):
    data = _subscribers(spark, sf)
    return ML.majority_baseline(data.train, data.test).unionByName(
        ML.random_baseline(data.train, data.test))


@query("M6", f"""
WITH {_SUBSCRIBERS.strip()},
c AS (SELECT lapsed, count(*) AS n FROM split WHERE NOT held GROUP BY 1),
t AS (SELECT sum(n) AS n, count(*) AS k, max(n) FILTER (WHERE lapsed = 0) AS neg, max(n) FILTER (WHERE lapsed = 1) AS pos FROM c)
SELECT c.lapsed, c.n AS rows, round(t.n / (t.k * c.n), 9) AS balanced_weight,
       round(CASE WHEN c.lapsed = 1 AND neg > 0 AND pos > 0 THEN neg / pos ELSE 1.0 END, 9) AS positive_weight FROM c, t""")
def class_weights(spark, sf):
    """The weights that the models give the rows of each class."""
    train = _subscribers(spark, sf).train
    counts = OS.class_counts(train)
    return train.groupBy("lapsed").agg(F.count("*").alias("rows")).select(
        "lapsed", "rows", F.round(ML.balanced_weight(counts), 9).alias("balanced_weight"),
        F.round(ML.positive_weight(counts), 9).alias("positive_weight"))


@query("M1 M2 M3 M4 M5 M6 M10 E1 W8")
def model_metrics(spark, sf):
    """Five classifiers on the order matrix, evaluated on the later snapshot."""
    data = _orders(spark, sf)
    trained = ML.train_models(cut_lineage(data.train))
    return M.evaluate(materialise(M.prediction_counts(trained.predict(cut_lineage(data.test)))))


@query("M11 W7")
def top_importances(spark, sf):
    data = _orders(spark, sf)
    trained = ML.train_models(data.train, names=ML.TREE_MODELS)
    return ML.top_features(trained.importances(spark), 5)


@query("M7 M6 V10", f"""
WITH {_SUBSCRIBERS.strip()},
c AS (SELECT lapsed, count(*) AS n FROM split WHERE NOT held GROUP BY 1)
SELECT lapsed, false AS synthetic, n AS rows FROM c
UNION ALL SELECT lapsed, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)""")
def oversampled_class_counts(spark, sf):
    data = _subscribers(spark, sf)
    made = OS.oversample(data.train)
    return made.groupBy("lapsed", "synthetic").agg(F.count(F.lit(1)).alias("rows"))


@query("M7", f"""
WITH {_SUBSCRIBERS.strip()},
v AS (SELECT s.customer_id, c_nationkey::DOUBLE AS n, length(c_name)::DOUBLE AS l, abs(c_acctbal) / 1000 AS b, c_mktsegment AS g
      FROM split s JOIN customer ON c_custkey = s.customer_id WHERE lapsed = 1 AND NOT held),
d AS (SELECT x.customer_id, (x.n - y.n) ** 2 + (x.l - y.l) ** 2 + (x.b - y.b) ** 2 + 2 * (x.g <> y.g)::INT AS d
      FROM v x JOIN v y ON x.customer_id <> y.customer_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY d) AS k FROM d)
SELECT customer_id, k::INT AS rank, round(sqrt(d), 6) AS distance FROM placed WHERE k <= 5""")
def oversampled_neighbours(spark, sf):
    """Distances of every row of the smaller class to its five nearest others."""
    train = _subscribers(spark, sf).train
    names = feature_columns(train)
    rows = train.where("lapsed = 1")
    point = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    near = OS.neighbours(rows, names).select("_x", F.posexplode("_near").alias("k", "to"))
    return rows.select("customer_id", point.alias("_x")).join(near, "_x").select(
        "customer_id", (F.col("k") + 1).alias("rank"), F.round(F.sqrt("to.gap"), 6).alias("distance"))


@query("M7")
def oversampled_rows(spark, sf):
    """The synthetic rows themselves; their geometry is checked in the tests."""
    return OS.oversample(_subscribers(spark, sf).train).where("synthetic")


@query("W8", f"""
WITH {Q.SCORES.strip()},
g AS (SELECT d.lang AS model, p.y, p.p FROM pred p JOIN documents d ON d.doc_id = p.customer_id),
c AS (SELECT model, p, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM g GROUP BY 1, 2),
r AS (SELECT *, sum(n0) OVER (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING) AS up FROM c),
a AS (SELECT model, sum(n1 * (up - n0 + 0.5 * n0))::DOUBLE / nullif(sum(n1) * sum(n0), 0) AS auc FROM r GROUP BY 1)
SELECT model, round(auc, 9) AS roc_auc FROM a ORDER BY auc DESC NULLS LAST, model LIMIT 1""")
def best_model_row(spark, sf):
    """Highest AUC, nulls last: here the language whose documents are ranked best."""
    lang = D.table(spark, sf, "documents").select(F.col("doc_id").alias("customer_id"), "lang")
    scored = D.document_scores(spark, sf).drop("model").join(lang, "customer_id")
    metrics = M.evaluate(scored.withColumnRenamed("lang", "model"))
    return ML.best_model(metrics).select("model", F.round("roc_auc", 9).alias("roc_auc"))


@query("T6 T7 A10")
def customer_segments(spark, sf):
    data = _orders(spark, sf)
    found = SG.segment_customers(data.train.drop("lapsed"))
    return P.segment_centroids(found.rows)


@query("T6", """
WITH f AS (SELECT unnest(['price', 'size']) AS feature, unnest([p_retailprice, p_size::DOUBLE]) AS v FROM part)
SELECT feature, median(v) AS median, CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25)
  THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE 1 END AS spread FROM f GROUP BY 1""")
def robust_scaling(spark, sf):
    parts = D.table(spark, sf, "part").select(
        F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return SG.robust_scaling(parts, ["price", "size"])


@query("T8", """
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer)
SELECT c_custkey AS customer_id, round(0.5 * (c_acctbal - a), 6) AS balance,
       round(-2.0 * (c_nationkey - n), 6) AS nation FROM customer, m""")
def linear_attributions(spark, sf):
    """Coefficient times distance from the background mean."""
    rows = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"))
    table = AT.linear_attribution(rows, ["balance", "nation"], [0.5, -2.0])
    return table.select(
        "customer_id", F.round("balance", 6).alias("balance"), F.round("nation", 6).alias("nation"))


@query("T10", """
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer)
SELECT 'balance' AS feature, round(avg(abs(0.5 * (c_acctbal - a))), 6) AS mean_abs FROM customer, m
UNION ALL SELECT 'nation', round(avg(abs(-2.0 * (c_nationkey - n))), 6) FROM customer, m""")
def mean_absolute_attributions(spark, sf):
    rows = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"))
    names = ["balance", "nation"]
    table = AT.mean_absolute(AT.linear_attribution(rows, names, [0.5, -2.0]), names)
    return table.withColumn("mean_abs", F.round("mean_abs", 6))


@query("T10", """
WITH m AS (SELECT avg(c_acctbal) AS a, avg(c_nationkey) AS n FROM customer),
p AS (SELECT 'balance' AS feature, c_custkey AS customer_id, c_acctbal::DOUBLE AS value, 0.5 * (c_acctbal - a) AS attribution FROM customer, m
      UNION ALL SELECT 'nation', c_custkey, c_nationkey::DOUBLE, -2.0 * (c_nationkey - n) FROM customer, m),
t AS (SELECT feature FROM p GROUP BY 1 ORDER BY avg(abs(attribution)) DESC, feature LIMIT 1)
SELECT feature, customer_id, round(value, 6) AS value, round(attribution, 6) AS attribution FROM p JOIN t USING (feature)""")
def dependence_points(spark, sf):
    """Value and attribution of every customer for the feature of the largest mean attribution."""
    rows = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"))
    names = ["balance", "nation"]
    pairs = AT.dependence_pairs(AT.linear_attribution(rows, names, [0.5, -2.0]), rows, names, 1)
    return pairs.withColumns({c: F.round(c, 6) for c in ("value", "attribution")})


@query("T9")
def tree_attributions(spark, sf):
    """Shapley values of the three ensembles for every test row."""
    return _attributions(spark, sf)[0]


@query("T9 M2 M3 M4", f"""
WITH {_SUBSCRIBERS.strip()}
SELECT model, customer_id, true AS adds_up FROM split, (SELECT unnest(['random_forest', 'xgboost', 'lightgbm']) AS model) WHERE held""")
def attribution_sums(spark, sf):
    """Base and attributions of a row add up to the share of the forest and the margins of the boosted ensembles."""
    table, trained, test = _attributions(spark, sf)
    total = sum((F.col(f"`{c}`") for c in trained.features), F.col("base_value"))
    shown = F.when(F.col("model") == "random_forest", total).otherwise(1 / (1 + F.exp(-total)))
    sums = table.select("model", "customer_id", shown.alias("shown"))
    p = trained.predict(test).select("model", "customer_id", "p")
    return sums.join(p, ["model", "customer_id"]).select("model", "customer_id", (F.abs(F.col("shown") - F.col("p")) < 1e-6).alias("adds_up"))


def _attributions(spark, sf):
    data = _subscribers(spark, sf)
    train, test = cut_lineage(data.train), cut_lineage(data.test)
    trained = ML.train_models(train, names=ML.TREE_MODELS)
    path = _shared_folder(spark)
    trained.models["random_forest"].write().save(path)
    found = AT.explain_models(trained, test, {"random_forest": path})
    parts = [table.select(F.lit(name).alias("model"), *table.columns) for name, table in found.items()]
    return reduce(DataFrame.unionByName, parts), trained, test


@query("T11 V8", """
WITH t AS (SELECT 22 + count(DISTINCT o_orderpriority) AS n FROM orders)
SELECT "group", n_columns, (n - n_columns)::INT AS n_remaining
FROM (VALUES ('purchase', 3), ('monetary', 4), ('inactivity', 1), ('review', 5),
  ('delivery', 4), ('payment', 2), ('cadence', 3)) AS g("group", n_columns), t""")
def ablation_groups(spark, sf):
    """Which columns of the order matrix each group removes; the one-hot columns follow the data."""
    table = A.global_table(*_order_cut(spark, sf), DA.STAR_ORDERS.groups)
    return AB.group_coverage(feature_columns(table), "star_orders", spark)


def _order_cut(spark, sf):
    from lapse.operators import labels as L

    events = D.market_events(spark, sf)
    return events, L.global_cutoffs(D.market_events(spark, sf, False), 180)


@query("T12 T13")
def ablation_scores(spark, sf):
    data = _subscribers(spark, sf)
    return AB.run_ablation(
        data.train, "star_subscribers", declared=DA.SUBSCRIBER_GROUPS)


@query("T13", """
WITH a AS (SELECT 'm' || (c_nationkey % 3) AS model,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'all_features' ELSE 'without_' || lower(c_mktsegment) END AS feature_set,
  avg(c_acctbal) AS auc FROM customer GROUP BY 1, 2),
d AS (SELECT a.model, replace(a.feature_set, 'without_', '') AS g, f.auc - a.auc AS drop
      FROM a JOIN a f ON a.model = f.model AND f.feature_set = 'all_features' WHERE a.feature_set <> 'all_features')
SELECT model, arg_max(g, drop) AS dominant_feature_group, round(max(drop), 6) AS auc_drop FROM d GROUP BY 1""")
def dominant_feature_groups(spark, sf):
    """The largest drop per model, on scores taken from customer balances."""
    table = D.table(spark, sf, "customer").groupBy(
        F.concat(F.lit("m"), F.col("c_nationkey") % 3).alias("model"),
        F.when(F.col("c_mktsegment") == "BUILDING", "all_features")
        .otherwise(F.concat(F.lit("without_"), F.lower("c_mktsegment"))).alias("feature_set"),
    ).agg(F.avg("c_acctbal").alias("mean_roc_auc"))
    return AB.dominant_groups(table).withColumn("auc_drop", F.round("auc_drop", 6))


@query("W12 T15", """
WITH y AS (SELECT o_orderstatus AS dataset, o_orderpriority AS model, year(o_orderdate) AS w,
  max(o_totalprice) AS auc FROM orders GROUP BY 1, 2, 3)
SELECT dataset, model, count(*) AS n_windows, round(arg_min(auc, w), 2) AS first_auc,
       round(arg_max(auc, w), 2) AS last_auc, round(arg_max(auc, w) - arg_min(auc, w), 2) AS trend
FROM y GROUP BY 1, 2 HAVING count(*) > 1""")
def score_trend(spark, sf):
    """Last minus first score over windows, on yearly top prices."""
    table = D.table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.year("o_orderdate").alias("window_days"),
    ).agg(F.max("o_totalprice").alias("roc_auc"))
    trend = compare.auc_trend(table)
    return trend.withColumns({c: F.round(c, 2) for c in ("first_auc", "last_auc", "trend")})


@query("T15")
def window_sensitivity(spark, sf):
    """Models per window on the order stream."""
    events = DA.STAR_ORDERS.events(spark, sf)
    return sensitivity.window_sensitivity(
        DA.STAR_ORDERS, events, [90, 180, 270], Settings())


@query("F1 L12")
def pipeline_metrics(spark, sf):
    """A whole run on the order stream: load, checks, split, all fits, all optional tables, evaluate."""
    return _whole(run_pipeline(spark, DA.STAR_ORDERS, sf))


@query("F1 L5 M7")
def oversampled_pipeline_metrics(spark, sf):
    """The same workflow on the user-disjoint route with oversampling: all models and all optional tables."""
    return _whole(run_pipeline(spark, DA.STAR_SHIPMENTS, sf, use_smote=True))


def _whole(result):
    """Metrics of a run in which no step failed; a run records failures, a query has only its rows to tell them by."""
    if result.skipped:
        raise RuntimeError(f"steps failed: {result.skipped}")
    return result.metrics
