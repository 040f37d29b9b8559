"""Metrics, curves, risk tables, tests and descriptive tables on scored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import group_tests as G
from lapse.operators import metrics as M
from lapse.operators import profile as P
from lapse.operators import risk as R
from lapse.plans.driver import sql as Q
from lapse.plans.driver.registry import query
from lapse.sources import driver as D

_PRED = f"WITH {Q.SCORES.strip()}"
_COUNTS = """
c AS (SELECT model, p, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg
      FROM pred GROUP BY model, p),
r AS (SELECT *, sum(n_pos) OVER w AS up_pos, sum(n_neg) OVER w AS up_neg,
             sum(n_pos) OVER (PARTITION BY model) AS pos, sum(n_neg) OVER (PARTITION BY model) AS neg
      FROM c WINDOW w AS (PARTITION BY model ORDER BY p ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, pos - up_pos + n_pos AS tp, neg - up_neg + n_neg AS fp FROM r)"""
_CUTS = ", ".join(f"{e!r}::DOUBLE" for e in M.linspace(0.01, 0.99, 50))


def _passed(value: str, edges, sign: str) -> str:
    return "(" + " + ".join(f"({value} {sign} {e!r}::DOUBLE)::INT" for e in edges) + ")"


_LEFT_BIN = _passed("p", M.linspace(0.0, 1.0, 11), ">=")
_RIGHT_BIN = _passed("p", M.linspace(0.0, 1.0, 11)[1:-1], ">")
_SQUARE_BIN = _passed("(p * p)", M.linspace(0.0, 1.0, 11)[1:-1], ">")


@query("E1 E2 E3 E4 E5", f"""{_PRED}, {_COUNTS.strip()},
k AS (SELECT model, count(*) AS n_test, count(*) FILTER (WHERE y = 1) AS n_pos,
  count(*) FILTER (WHERE y = 0) AS n_neg,
  count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp,
  avg((p - y) * (p - y)) AS brier FROM pred GROUP BY model),
rank AS (SELECT model, sum(n_pos * (up_neg - n_neg + 0.5 * n_neg))::DOUBLE / (max(pos) * max(neg)) AS auc,
  sum(n_pos * tp::DOUBLE / (tp + fp)) / max(pos) AS ap FROM x GROUP BY model),
bins AS (SELECT model, {_LEFT_BIN} AS b, count(*) AS n, sum(y) AS sy, sum(p) AS sp
  FROM pred GROUP BY 1, 2),
ece AS (SELECT model, sum(CASE WHEN b BETWEEN 1 AND 10 THEN abs(sy - sp) ELSE 0 END) / sum(n) AS ece
  FROM bins GROUP BY model)
SELECT model, n_test, n_pos, n_neg, (tp + tn) / n_test AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(auc, 9) AS roc_auc,
  round(ap, 9) AS avg_precision, round(brier, 9) AS brier_score, round(ece, 9) AS calibration_error,
  tn, fp, fn, tp
FROM k JOIN rank USING (model) JOIN ece USING (model)""")
def metric_table(spark, sf):
    table = M.evaluate(D.document_scores(spark, sf))
    soft = ("f1", "roc_auc", "avg_precision", "brier_score", "calibration_error")
    return table.withColumns({c: F.round(c, 9) for c in soft})


@query("E6", f"""{_PRED}, t AS (SELECT unnest([{_CUTS}]) AS threshold),
k AS (SELECT model, threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
      count(*) FILTER (WHERE p >= threshold) AS called, count(*) FILTER (WHERE y = 1) AS pos
      FROM pred, t GROUP BY model, threshold)
SELECT model, threshold, coalesce(tp / nullif(called, 0), 0) AS precision,
       coalesce(tp / nullif(pos, 0), 0) AS recall,
       round(coalesce(2.0::DOUBLE * tp / nullif(called + pos, 0), 0), 9) AS f1 FROM k""")
def threshold_sweep(spark, sf):
    table = M.threshold_table(D.document_scores(spark, sf))
    return table.withColumn("f1", F.round("f1", 9))


@query("E7", f"""{_PRED}, {_COUNTS.strip()},
s AS (SELECT *, lag(n_pos) OVER v AS lp, lag(n_neg) OVER v AS ln, lead(p) OVER v AS higher
      FROM x WINDOW v AS (PARTITION BY model ORDER BY p))
SELECT model, p AS threshold, fp / neg AS fpr, tp / pos AS tpr FROM s
WHERE lp IS NULL OR higher IS NULL OR lp <> n_pos OR ln <> n_neg
UNION ALL SELECT DISTINCT model, 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM pred""")
def roc_curve(spark, sf):
    return M.roc_points(D.document_scores(spark, sf))


@query("E8", f"""{_PRED}, {_COUNTS.strip()}
SELECT model, p AS threshold, tp / (tp + fp) AS precision, tp / pos AS recall FROM x
UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM pred""")
def precision_recall_curve(spark, sf):
    return M.pr_points(D.document_scores(spark, sf))


_CURVE = f"""
SELECT model, {_RIGHT_BIN} AS bin, count(*) AS n,
       avg(y) AS prob_true, round(avg(p), 9) AS prob_pred FROM pred GROUP BY 1, 2"""


@query("E9", f"{_PRED} {_CURVE}")
def calibration_curve(spark, sf):
    curve = M.calibration_curve(D.document_scores(spark, sf))
    return curve.withColumn("prob_pred", F.round("prob_pred", 9))


@query("E10")
def calibration_band(spark, sf):
    """Bootstrap band: random by nature, checked in the tests for coverage and stability."""
    return M.calibration_band(D.document_scores(spark, sf))


@query("E12", f"""{_PRED},
a AS (SELECT {_RIGHT_BIN} AS bin, avg(y) AS t, avg(p) AS q FROM pred GROUP BY 1),
b AS (SELECT {_SQUARE_BIN} AS bin, avg(y) AS t, avg(p * p) AS q FROM pred GROUP BY 1)
SELECT 'length' AS model, coalesce(a.bin, b.bin) AS bin, a.t AS original_true,
       round(a.q, 9) AS original_pred, b.t AS smote_true, round(b.q, 9) AS smote_pred
FROM a FULL JOIN b USING (bin)""")
def calibration_by_mode(spark, sf):
    """Curves of two score columns of the same model, side by side."""
    original = D.document_scores(spark, sf)
    other = original.withColumn("p", F.col("p") * F.col("p"))
    table = M.calibration_comparison(original, other)
    return table.withColumns(
        {c: F.round(c, 9) for c in ("original_pred", "smote_pred")})


@query("E11 W5 X6", f"""{_PRED},
s AS (SELECT customer_id AS customer_unique_id, p AS lapse_probability,
             round_even(p * 100, 0)::INT AS risk_score FROM pred),
k AS (SELECT risk_score, count(*) AS n FROM s GROUP BY 1),
u AS (SELECT risk_score, n, sum(n) OVER (ORDER BY risk_score ROWS UNBOUNDED PRECEDING) AS upto,
             sum(n) OVER () AS total FROM k)
SELECT customer_unique_id, lapse_probability, risk_score,
       (upto - (n - 1) / 2.0::DOUBLE) / total * 100 AS risk_percentile,
       CASE WHEN risk_score < 30 THEN 'Low' WHEN risk_score < 70 THEN 'Medium' ELSE 'High' END AS risk_tier
FROM s JOIN u USING (risk_score)""")
def risk_table(spark, sf):
    return R.risk_table(D.document_scores(spark, sf))


@query("E13", f"""{_PRED},
a AS (SELECT quality::VARCHAR AS dataset, y, p, yhat, 4.0::DOUBLE * p * (1.0::DOUBLE - p) AS p2, (4.0::DOUBLE * p * (1.0::DOUBLE - p) >= 0.5)::INT AS yhat2 FROM pred),
m AS (SELECT dataset, 'length' AS model, avg((p - y) * (p - y)) AS original_brier,
  avg((p2 - y) * (p2 - y)) AS smote_brier,
  coalesce(2.0::DOUBLE * sum(y * yhat) / nullif(sum(y) + sum(yhat), 0), 0) AS original_f1,
  coalesce(2.0::DOUBLE * sum(y * yhat2) / nullif(sum(y) + sum(yhat2), 0), 0) AS smote_f1 FROM a GROUP BY 1),
k AS (SELECT dataset, y, rank() OVER (PARTITION BY dataset ORDER BY p) + (count(*) OVER (PARTITION BY dataset, p) - 1) / 2.0::DOUBLE AS r,
  rank() OVER (PARTITION BY dataset ORDER BY p2) + (count(*) OVER (PARTITION BY dataset, p2) - 1) / 2.0::DOUBLE AS r2 FROM a),
u AS (SELECT dataset, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS original_auc,
  (sum(r2 * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS smote_auc FROM k GROUP BY 1)
SELECT dataset, model, round(original_auc, 9) AS original_auc, round(smote_auc, 9) AS smote_auc,
  round(smote_auc - original_auc, 9) AS auc_change, round(original_brier, 9) AS original_brier, round(smote_brier, 9) AS smote_brier,
  round(smote_brier - original_brier, 9) AS brier_change, round(original_f1, 9) AS original_f1,
  round(smote_f1, 9) AS smote_f1, round(smote_f1 - original_f1, 9) AS f1_change FROM m JOIN u USING (dataset)""")
def mode_comparison(spark, sf):
    from lapse.plans.compare import comparison_table

    base = D.document_scores(spark, sf).withColumn("dataset", F.col("quality").cast("string"))
    # Scores of the second mode rank otherwise: they fall again above a half.
    other = base.withColumn("p", F.lit(4.0) * F.col("p") * (F.lit(1.0) - F.col("p")))
    other = other.withColumn("yhat", F.when(F.col("p") >= 0.5, 1).otherwise(0))
    keys = ["dataset", "model"]
    table = comparison_table(M.evaluate(base, keys), M.evaluate(other, keys))
    wanted = ("original_auc", "smote_auc", "auc_change", "original_brier", "smote_brier", "brier_change", "original_f1", "smote_f1", "f1_change")
    return table.select("dataset", "model", *[F.round(c, 9).alias(c) for c in wanted])


@query("A15", f"""{_PRED},
a AS (SELECT quality::VARCHAR AS dataset, d.lang AS model, y, p, 4.0::DOUBLE * p * (1.0::DOUBLE - p) AS p2
      FROM pred JOIN documents d ON d.doc_id = customer_id),
k AS (SELECT dataset, model, y,
  rank() OVER (PARTITION BY dataset, model ORDER BY p) + (count(*) OVER (PARTITION BY dataset, model, p) - 1) / 2.0::DOUBLE AS r,
  rank() OVER (PARTITION BY dataset, model ORDER BY p2) + (count(*) OVER (PARTITION BY dataset, model, p2) - 1) / 2.0::DOUBLE AS r2
  FROM a),
u AS (SELECT dataset, model, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS o,
  (sum(r2 * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0) AS s FROM k GROUP BY 1, 2)
SELECT dataset, round(avg(o), 9) AS original_auc, round(avg(s), 9) AS smote_auc FROM u GROUP BY 1""")
def mean_auc_by_dataset(spark, sf):
    """Mean over languages, as models, of both modes' AUC."""
    from lapse.plans.compare import comparison_table

    lang = D.table(spark, sf, "documents").select(F.col("doc_id").alias("customer_id"), F.col("lang").alias("model"))
    base = D.document_scores(spark, sf).drop("model").join(lang, "customer_id").withColumn(
        "dataset", F.col("quality").cast("string"))
    other = base.withColumn("p", F.lit(4.0) * F.col("p") * (F.lit(1.0) - F.col("p")))
    keys = ["dataset", "model"]
    table = P.mean_auc_per_dataset(comparison_table(M.evaluate(base, keys), M.evaluate(other, keys)))
    return table.select("dataset", *[F.round(c, 9).alias(c) for c in ("original_auc", "smote_auc")])


# --------------------------------------------------------------------------------- statistics

_LONG = """
long AS (SELECT y, unnest(['n_chars', 'words', 'quality']) AS feature,
                unnest([n_chars::DOUBLE, words::DOUBLE, quality::DOUBLE]) AS value FROM feats)"""
_FEATS = """
WITH feats AS (SELECT l.doc_id AS customer_id, l.toxic AS y, l.quality, d.n_chars,
                      length(d.text) - length(replace(d.text, ' ', '')) AS words
               FROM labels l JOIN documents d USING (doc_id))"""


def _document_features(spark, sf):
    labels = D.table(spark, sf, "labels")
    documents = D.table(spark, sf, "documents").select(
        "doc_id", "n_chars",
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("words"))
    joined = labels.join(documents, "doc_id")
    return joined.select(
        F.col("doc_id").alias("customer_id"), F.col("toxic").alias("lapsed"),
        F.col("n_chars").cast("double").alias("n_chars"), F.col("words").cast("double").alias("words"),
        F.col("quality").cast("double").alias("quality"))


@query("T1 T2 T3", f"""{_FEATS}, {_LONG.strip()},
c AS (SELECT feature, value, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1
      FROM long GROUP BY 1, 2),
r AS (SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS up0 FROM c),
m AS (SELECT feature, median(value) FILTER (WHERE y = 0) AS median_retained,
             median(value) FILTER (WHERE y = 1) AS median_lapsed FROM long GROUP BY 1),
u AS (SELECT feature, sum(n0)::BIGINT AS n_retained, sum(n1)::BIGINT AS n_lapsed,
  sum(n1 * (up0 - n0 + 0.5 * n0))::DOUBLE AS u_lapsed,
  sum((n0 + n1)::DOUBLE * (n0 + n1) * (n0 + n1) - (n0 + n1)) AS tie_term FROM r GROUP BY 1)
SELECT feature, n_retained, n_lapsed, u_lapsed, tie_term, median_retained, median_lapsed,
  round(2 * u_lapsed / (n_retained::DOUBLE * n_lapsed) - 1, 9) AS cliffs_delta,
  round((greatest(u_lapsed, n_retained * n_lapsed - u_lapsed) - n_retained * n_lapsed / 2 - 0.5)
    / sqrt(n_retained * n_lapsed / 12 * (n_retained + n_lapsed + 1
      - tie_term / ((n_retained + n_lapsed)::DOUBLE * (n_retained + n_lapsed - 1)))), 9) AS z_score
FROM u JOIN m USING (feature)""")
def rank_sum_statistics(spark, sf):
    """U, tie term, medians, effect size and z per feature; the p-value follows from z."""
    stats = G.rank_sums(G.value_counts(_document_features(spark, sf)))
    return stats.withColumns({c: F.round(c, 9) for c in ("cliffs_delta", "z_score")})


@query("T1 T2 T3 T4 T5")
def feature_tests(spark, sf):
    """With p-values and correction; the normal tail has no SQL function, so rows only."""
    return G.feature_tests(_document_features(spark, sf))


@query("T4 T5", """
WITH p AS (SELECT c_mktsegment AS feature, count(*) FILTER (WHERE c_acctbal < 0) / (count(*) * 20.0::DOUBLE) AS p_value
           FROM customer GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS i, count(*) OVER () AS m FROM p)
SELECT feature, p_value,
  round(least(1.0, min(p_value * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 12) AS p_adjusted_bh,
  least(1.0, min(p_value * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) < 0.05 AS significant_bh,
  CASE WHEN 100 * p_value < 0.147 THEN 'negligible' WHEN 100 * p_value < 0.33 THEN 'small'
       WHEN 100 * p_value < 0.474 THEN 'medium' ELSE 'large' END AS effect
FROM k""")
def adjusted_significance(spark, sf):
    """Benjamini-Hochberg and effect labels over a per-segment rate used as a p-value."""
    rates = D.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("feature")).agg(
        (F.count(F.when(F.col("c_acctbal") < 0, 1)) / (F.count(F.lit(1)) * 20.0)).alias("p_value"))
    table = G.adjust_bh(rates).withColumn("effect", G.effect_label(F.col("p_value") * 100))
    return table.withColumn("p_adjusted_bh", F.round("p_adjusted_bh", 12))


# ------------------------------------------------------------------------- descriptive tables


@query("A8", f"""{_PRED}
SELECT CASE WHEN y = 1 AND yhat = 1 THEN 'true_positive' WHEN y = 0 AND yhat = 0 THEN 'true_negative'
            WHEN y = 0 AND yhat = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type,
       count(*) AS n, round(avg(p), 9) AS avg_lapse_prob, round(avg(n_chars), 6) AS n_chars,
       round(avg(quality), 9) AS quality FROM pred GROUP BY 1""")
def error_groups(spark, sf):
    table = R.error_groups(D.document_scores(spark, sf), ["n_chars", "quality"])
    return table.select(
        "error_type", "n", F.round("avg_lapse_prob", 9).alias("avg_lapse_prob"),
        F.round("n_chars", 6).alias("n_chars"), F.round("quality", 9).alias("quality"))


@query("A9", f"""{_PRED},
m AS (SELECT avg(n_chars) FILTER (WHERE y = 0 AND yhat = 1) AS f1, avg(n_chars) FILTER (WHERE y = 1 AND yhat = 0) AS g1,
             avg(quality) FILTER (WHERE y = 0 AND yhat = 1) AS f2, avg(quality) FILTER (WHERE y = 1 AND yhat = 0) AS g2 FROM pred)
SELECT 'n_chars' AS feature, f1 AS false_positive_mean, g1 AS false_negative_mean, f1 - g1 AS difference FROM m
WHERE f1 IS NOT NULL AND g1 IS NOT NULL
UNION ALL SELECT 'quality', f2, g2, f2 - g2 FROM m WHERE f2 IS NOT NULL AND g2 IS NOT NULL""")
def error_contrast(spark, sf):
    return R.error_contrast(D.document_scores(spark, sf), ["n_chars", "quality"])


@query("A7", """
SELECT 'raw' AS stage, event_type, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'mapped', CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'cart_add'
  WHEN 'signup' THEN 'wishlist' WHEN 'purchase' THEN 'purchase' ELSE 'other' END, count(*) FROM events GROUP BY 2""")
def event_type_counts(spark, sf):
    raw = P.event_type_counts(D.table(spark, sf, "events")).withColumn("stage", F.lit("raw"))
    mapped = P.event_type_counts(D.click_events(spark, sf)).withColumn("stage", F.lit("mapped"))
    return raw.unionByName(mapped)


@query("A5", """
SELECT avg(toxic) AS lapse_rate, count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1) AS imbalance_ratio,
       count(*) FILTER (WHERE toxic = 1) AS n_pos, count(*) FILTER (WHERE toxic = 0) AS n_neg, count(*) AS n_total
FROM labels""")
def class_balance(spark, sf):
    return P.imbalance_metrics(D.table(spark, sf, "labels"), "toxic")


@query("A11", """
SELECT quality, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM labels GROUP BY 1""")
def class_percentages(spark, sf):
    return P.class_distribution(D.table(spark, sf, "labels"), "quality")


@query("A12", f"""{_FEATS},
r AS (SELECT corr(n_chars, words) AS a, corr(n_chars, quality) AS b, corr(words, quality) AS c FROM feats)
SELECT 'n_chars' AS feature_a, 'n_chars' AS feature_b, 1.0::DOUBLE AS r FROM r
UNION ALL SELECT 'words', 'words', 1.0 FROM r UNION ALL SELECT 'quality', 'quality', 1.0 FROM r
UNION ALL SELECT 'n_chars', 'words', round(a, 9) FROM r UNION ALL SELECT 'words', 'n_chars', round(a, 9) FROM r
UNION ALL SELECT 'n_chars', 'quality', round(b, 9) FROM r UNION ALL SELECT 'quality', 'n_chars', round(b, 9) FROM r
UNION ALL SELECT 'words', 'quality', round(c, 9) FROM r UNION ALL SELECT 'quality', 'words', round(c, 9) FROM r""")
def feature_correlations(spark, sf):
    table = P.correlations(_document_features(spark, sf))
    return table.withColumn("r", F.round("r", 9))


@query("A13", f"""{_FEATS}, {_LONG.strip()},
q AS (SELECT feature, y, count(*) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1, 2)
SELECT feature, y AS lapsed, any_value(n) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
  min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM long JOIN q USING (feature, y) GROUP BY 1, 2""")
def box_plot_table(spark, sf):
    return P.box_stats(_document_features(spark, sf), ["n_chars", "words", "quality"])


@query("A14", f"""
WITH {Q.MARKET.strip()}, d AS (SELECT customer_id, avg(delay) AS v FROM market GROUP BY 1),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM d)
SELECT least(floor((v - lo) / ((hi - lo) / 50)), 49)::INT AS bin, count(*) AS n FROM d, e GROUP BY 1""")
def delay_histogram(spark, sf):
    """50 bins of the mean delivery delay per customer."""
    delays = D.market_events(spark, sf).groupBy("customer_id").agg(
        F.avg("delivery_delay").alias("avg_delivery_delay_days"))
    return P.histogram(delays, "avg_delivery_delay_days").select("bin", "n")


@query("A6", f"""
WITH {Q.MARKET.strip()},
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM market),
k AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE product_id IS NULL) AS no_product,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers,
  strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(make_timestamp(max(t)), '%Y-%m-%d %H:%M:%S') AS span,
  count(DISTINCT customer_id) AS customers, round(avg(review_score), 2) AS review_mean FROM market, q),
u AS (SELECT (SELECT count(*) FROM market) - (SELECT count(*) FROM (SELECT DISTINCT * FROM market)) AS copies)
SELECT 'total_rows' AS metric, total_rows::VARCHAR AS value FROM k
UNION ALL SELECT 'total_columns', '8' FROM k UNION ALL SELECT 'duplicate_rows', copies::VARCHAR FROM u
UNION ALL SELECT 'columns_with_missing', (no_product > 0)::INT::VARCHAR FROM k
UNION ALL SELECT 'missing:product_id', no_product::VARCHAR FROM k WHERE no_product > 0
UNION ALL SELECT 'date_range', span FROM k
UNION ALL SELECT 'transaction_value_outliers_iqr', outliers::VARCHAR FROM k
UNION ALL SELECT 'review_score_missing', '0' FROM k
UNION ALL SELECT 'review_score_mean', review_mean::VARCHAR FROM k
UNION ALL SELECT 'unique_customers', customers::VARCHAR FROM k""")
def data_quality(spark, sf):
    return P.quality_report(
        D.market_events(spark, sf), time="event_time", customer="customer_id",
        outlier_columns=["transaction_value"])
