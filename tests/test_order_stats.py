import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapse.operators import order_stats as o


def _skewed(spark, n=6000):
    rng = np.random.default_rng(5)
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.integers(0, 9, n)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("direct_rows", [10**6, 50])
def test_quantiles_match_numpy(spark, direct_rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(10, 3000), np.full(2000, 4.0)])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probs = [0.0, 0.25, 0.5, 0.7, 0.999, 1.0]
    got = o.exact_quantiles(df, "x", probs, direct_rows=direct_rows)
    assert np.allclose(got, np.quantile(values, probs))


def test_quantile_of_two_values_and_empty(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0] * 60 + [2.0] * 60}))
    assert o.exact_quantiles(df, "x", [0.5], direct_rows=10) == [1.5]
    assert o.exact_quantiles(df.where("x > 5"), "x", [0.5]) == [None]
    assert o.order_statistic(df, "x", 60, direct_rows=10) == 2.0


@pytest.mark.parametrize("limit", [10**6, 300])
def test_positions_totals_previous(spark, limit):
    pdf, df = _skewed(spark)
    groups = o.slice_groups(df, ["k"], "t", row_limit=limit)
    assert groups.sliced == (limit == 300)
    want = pdf.sort_values(["k", "t"]).copy()
    want["position"] = want.groupby("k").cumcount() + 1
    want["run_v"] = want.groupby("k")["v"].cumsum()
    want["previous"] = want.groupby("k")["t"].shift(1)
    got = o.positions(groups).toPandas().sort_values(["k", "t"])
    assert got["position"].tolist() == want["position"].tolist()
    got = o.running_totals(groups, ["v"]).toPandas().sort_values(["k", "t"])
    assert got["run_v"].tolist() == want["run_v"].tolist()
    got = o.previous_value(groups, "t").toPandas().sort_values(["k", "t"])
    assert got["previous"].fillna(-1).tolist() == want["previous"].fillna(-1).tolist()


def test_global_running_total_descending(spark):
    pdf, df = _skewed(spark, 2000)
    groups = o.slice_groups(df, [], "t", descending=True, row_limit=100)
    got = o.running_totals(groups, ["v"]).toPandas().sort_values("t", ascending=False)
    want = pdf.sort_values("t", ascending=False)["v"].cumsum()
    assert got["run_v"].tolist() == want.tolist()


def test_null_keys_keep_their_positions(spark):
    pdf = pd.DataFrame({"k": [None] * 20 + ["a"] * 400, "t": range(420), "v": 1})
    df = spark.createDataFrame(pdf, "k string, t int, v int")
    groups = o.slice_groups(df, ["k"], "t", row_limit=50)
    got = o.positions(groups, size="n").toPandas()
    nulls = got[got.k.isna()].sort_values("t")
    assert nulls["position"].tolist() == list(range(1, 21)) and set(nulls["n"]) == {20}
    run = o.running_totals(groups, ["v"]).toPandas()
    assert run[run.k == "a"]["run_v"].max() == 400


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("tie", ["long", "string"])
def test_tied_rows_are_cut_by_the_tie_breaker(spark, tie, descending):
    n = 3000
    pdf = pd.DataFrame({"k": "a", "t": [5] * 2500 + list(range(n - 2500)), "u": range(n), "v": 1})
    pdf = pdf.sample(frac=1, random_state=1)
    pdf["u"] = pdf["u"].map("{:05d}".format) if tie == "string" else pdf["u"]
    df = spark.createDataFrame(pdf, f"k string, t int, u {tie}, v int")
    groups = o.slice_groups(df, ["k"], "t", ["u"], descending=descending, row_limit=200)
    sizes = groups.frame.groupBy("_slice").count().toPandas()["count"]
    assert sizes.max() <= 500
    got = o.positions(groups).toPandas().sort_values("position")
    want = pdf.sort_values(["t", "u"], ascending=not descending)
    assert got["u"].tolist() == want["u"].tolist() and got["position"].tolist() == list(range(1, n + 1))
    if not descending:
        before = o.previous_value(groups, "u", "b").toPandas().sort_values(["t", "u"])["b"].tolist()
        assert before[1:] == want["u"].tolist()[:-1]


def test_ties_in_two_columns_are_cut_by_the_third(spark):
    pdf = pd.DataFrame({"k": ["a"] * 1000 + ["b"] * 30, "t": 1, "d": True, "u": range(1030), "v": 1})
    df = spark.createDataFrame(pdf, "k string, t int, d boolean, u int, v int")
    groups = o.slice_groups(df, ["k"], "t", ["d", "u"], row_limit=50)
    assert groups.frame.groupBy("k", "_slice").count().toPandas()["count"].max() <= 100
    got = o.running_totals(groups, ["v"]).toPandas()
    assert got[got.k == "a"].sort_values("u")["run_v"].tolist() == list(range(1, 1001))
    assert got[got.k == "b"].sort_values("u")["run_v"].tolist() == list(range(1, 31))


def test_many_slices_stay_near_the_limit(spark):
    df = spark.range(60_000).selectExpr("'a' AS k", "id AS t")
    groups = o.slice_groups(df, ["k"], "t", row_limit=100)
    assert groups.frame.groupBy("_slice").count().agg({"count": "max"}).first()[0] <= 200


@pytest.mark.parametrize("descending", [False, True])
def test_texts_that_share_their_first_bytes(spark, descending):
    n = 4_000
    names = [f"the same twenty bytes in front {i:06d}" for i in range(n)]
    df = spark.createDataFrame([("a", x, 1) for x in names] + [(None, x, 1) for x in names[:500]], "k string, t string, v int").repartition(5)
    groups = o.slice_groups(df, ["k"], "t", descending=descending, row_limit=150)
    assert groups.frame.where("k = 'a'").groupBy("_slice").count().agg({"count": "max"}).first()[0] <= 300
    got = o.positions(groups, size="n").toPandas()
    for key, size in (("a", n), (None, 500)):
        part = got[got.k.isna() if key is None else got.k == key].sort_values("position")
        want = sorted(names[:size], reverse=descending)
        assert part["t"].tolist() == want and part["position"].tolist() == list(range(1, size + 1)) and set(part["n"]) == {size}


def test_ties_of_any_kind_spread_where_order_means_nothing(spark):
    df = spark.range(3_000).selectExpr("1 AS k", "7 AS t", "id AS u")
    groups = o.slice_groups(df, ["k"], "t", row_limit=100, spread_ties=F.xxhash64("u"))
    assert groups.frame.groupBy("_slice").count().agg({"count": "max"}).first()[0] <= 250
    assert sorted(r.position for r in o.positions(groups).collect()) == list(range(1, 3_001))


def test_many_hot_keys(spark):
    df = spark.range(20_000).selectExpr("id % 400 AS k", "id AS t", "1 AS v")
    got = o.running_totals(o.slice_groups(df, ["k"], "t", row_limit=20), ["v"])
    assert got.groupBy("k").agg(F.max("run_v").alias("m"), F.count_distinct("run_v").alias("d")).where("m <> 50 or d <> 50").count() == 0
