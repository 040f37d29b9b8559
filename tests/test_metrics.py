import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapse.operators import group_tests as G
from lapse.operators import metrics as M
from lapse.operators import risk as R


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(y, p):
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp = ((p >= t) & (y == 1)).sum()
        recall = tp / (y == 1).sum()
        ap += (recall - last) * tp / (p >= t).sum()
        last = recall
    return ap


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    p = np.round(np.clip(rng.normal(0.4 + 0.15 * y, 0.25), 0, 1), 2)
    return y, p


@pytest.fixture(scope="module")
def pred(spark, data):
    y, p = data
    pdf = pd.DataFrame({"model": "m", "customer_id": range(len(y)), "y": y, "p": p})
    pdf["yhat"] = (pdf.p >= 0.5).astype(int)
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_auc_and_ap(pred, data, limit):
    y, p = data
    row = M.ranking_metrics(pred, row_limit=limit).first()
    assert row["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert row["avg_precision"] == pytest.approx(brute_ap(y, p))


def test_auc_survives_monotone_maps(pred):
    a = M.ranking_metrics(pred).first()["roc_auc"]
    b = M.ranking_metrics(pred.withColumn("p", F.col("p") * F.col("p") / 3)).first()["roc_auc"]
    assert a == pytest.approx(b)


def test_calibration_error_ignores_one(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 1), ("m", 0, 0.3, 0)], "model string, y int, p double, yhat int")
    # bin of 0.3: the third edge is 0.30000000000000004, so 0.3 sits in [0.2, 0.3)
    assert M.calibration_error(df).first()["calibration_error"] == pytest.approx(0.15)


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([("m", 1, 0.4, 0), ("m", 1, 0.6, 1)], "model string, y int, p double, yhat int")
    row = M.evaluate(df).first()
    assert row["roc_auc"] is None and row["recall"] == 0.5 and row["n_neg"] == 0


def test_no_scores(spark):
    df = spark.createDataFrame([("m", 1, None, 0), ("m", 0, None, 0)], "model string, y int, p double, yhat int")
    row = M.evaluate(df).first()
    assert row["roc_auc"] is None and row["precision"] == 0.0 and row["accuracy"] == 0.5


def test_thresholds(pred, data):
    y, p = data
    table = {round(r["threshold"], 4): r for r in M.threshold_table(pred).collect()}
    assert len(table) == 50
    for t, row in table.items():
        called = p >= row["threshold"]
        tp = (called & (y == 1)).sum()
        assert row["recall"] == pytest.approx(tp / y.sum())
        assert row["precision"] == pytest.approx(tp / called.sum() if called.sum() else 0.0)


@pytest.mark.parametrize("limit", [10**6, 20])
def test_roc_curve_area(pred, data, limit):
    y, p = data
    full = M.roc_points(pred, drop_collinear=False, row_limit=limit).toPandas().sort_values(["fpr", "tpr"])
    thin = M.roc_points(pred, row_limit=limit).toPandas().sort_values(["fpr", "tpr"])
    assert len(thin) < len(full) == len(set(p)) + 1
    for pdf in (full, thin):
        assert np.trapezoid(pdf.tpr, pdf.fpr) == pytest.approx(brute_auc(y, p))
        assert (pdf.fpr.iloc[0], pdf.tpr.iloc[-1]) == (0.0, 1.0)


def test_band_brackets_curve(pred):
    pdf = M.calibration_band(pred, replicates=100).toPandas()
    assert ((pdf.lower <= pdf.prob_true + 1e-9) & (pdf.prob_true <= pdf.upper + 1e-9)).all()
    again = M.calibration_band(pred.repartition(5), replicates=100).toPandas()
    assert np.allclose(pdf.sort_values("bin").lower, again.sort_values("bin").lower)


def test_risk_percentiles(pred, data):
    _, p = data
    got = R.risk_table(pred).toPandas().set_index("customer_unique_id").sort_index()
    want = pd.Series(np.round(p * 100)).rank(pct=True) * 100
    assert np.allclose(got.risk_percentile, want)
    assert set(got.risk_tier[got.risk_score < 30]) == {"Low"}


@pytest.mark.parametrize("limit", [10**6, 20])
def test_rank_test_against_brute_force(spark, data, limit):
    y, p = data
    m = spark.createDataFrame(pd.DataFrame({"customer_id": range(len(y)), "lapsed": y, "f": p, "g": -p}))
    out = {r["feature"]: r for r in G.feature_tests(m, row_limit=limit).collect()}
    auc = brute_auc(y, p)
    assert out["f"]["cliffs_delta"] == pytest.approx(2 * auc - 1)
    assert out["g"]["cliffs_delta"] == pytest.approx(1 - 2 * auc)
    assert out["f"]["median_lapsed"] == pytest.approx(np.median(p[y == 1]))
    assert out["f"]["median_retained"] == pytest.approx(np.median(p[y == 0]))
    n1, n0 = y.sum(), (1 - y).sum()
    n = n1 + n0
    _, t = np.unique(p, return_counts=True)
    sd = math.sqrt(n1 * n0 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    u = max(auc, 1 - auc) * n1 * n0
    assert out["f"]["p_value"] == pytest.approx(math.erfc((u - n1 * n0 / 2 - 0.5) / sd / math.sqrt(2)))


def test_exact_distribution():
    from itertools import combinations

    n1, n2 = 5, 6
    us = []
    for pick in combinations(range(n1 + n2), n1):
        us.append(sum(r - i for i, r in enumerate(pick)))
    us = np.array(us)
    for u in (0, 4, 15, 22):
        want = min(1.0, 2 * (us >= max(u, n1 * n2 - u)).mean())
        assert G._exact_two_sided(n1, n2, u) == pytest.approx(want)


def test_bh(spark):
    ps = [0.001, 0.02, 0.03, 0.04, 0.9]
    df = spark.createDataFrame([(f"f{i}", p) for i, p in enumerate(ps)], "feature string, p_value double")
    got = [r["p_adjusted_bh"] for r in G.adjust_bh(df).orderBy("feature").collect()]
    assert got == pytest.approx([0.005, 0.05, 0.05, 0.05, 0.9])
