import tempfile
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapse.operators import ablation as AB
from lapse.operators import attribution as AT
from lapse.operators import metrics as M
from lapse.operators import models as L
from lapse.operators import oversample as OS
from lapse.operators import segments as SG
from lapse.operators import splits as SP
from lapse.settings import ModelSettings

SMALL = ModelSettings(
    lr_max_iter=50, rf_trees=5, rf_depth=4, rf_min_leaf=5, gbt_rounds=3, gbt_depth=3,
    boost2_rounds=3, svm_max_iter=10, svm_folds=2)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(7)
    n = 300
    y = (rng.random(n) < 0.25).astype(int)
    pdf = pd.DataFrame({
        "customer_id": range(n), "lapsed": y,
        "total_orders": rng.poisson(4 - 2 * y) * 1.0,
        "total_spent": rng.normal(100 - 40 * y, 30),
        "days_since_last_purchase": rng.normal(20 + 30 * y, 15),
        "noise": rng.random(n),
    })
    return spark.createDataFrame(pdf).cache()


def test_nearest_matches_brute_force():
    rng = np.random.default_rng(0)
    x = rng.random((60, 3))
    got = OS.nearest(x, x, np.ones(60, dtype=int), 5, True)
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [row for _, row in got[i]] == x[np.argsort(d)[:5]].tolist()


@pytest.mark.parametrize("cell_rows", [1_000, 37, 5])
def test_neighbours_do_not_depend_on_cells(spark, cell_rows):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(150, 3)), np.repeat([[0.5, 0.5, 0.5]], 30, axis=0),
                   np.repeat([[2.0, 2.0, 2.0]], 3, axis=0)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    found = OS.neighbours(df, ["a", "b", "c"], 5, cell_rows).collect()
    assert sum(r["_n"] for r in found) == len(x)
    for r in found:
        gaps = sorted(((x - np.array(r["_x"])) ** 2).sum(1))[1:6]
        assert np.allclose([n["gap"] for n in r["_near"]], gaps)
        assert np.allclose([((np.array(n["x"]) - r["_x"]) ** 2).sum() for n in r["_near"]], gaps)


@pytest.mark.parametrize("cell_rows", [10_000, 20])
def test_oversample_balances_between_neighbours(matrix, cell_rows):
    out = OS.oversample(matrix, cell_rows=cell_rows)
    counts = OS.class_counts(out)
    assert counts[0] == counts[1]
    real = matrix.where("lapsed = 1").toPandas()
    made = out.where("synthetic").toPandas()
    names = ["total_orders", "total_spent", "days_since_last_purchase", "noise"]
    lo, hi = real[names].min(), real[names].max()
    assert ((made[names] >= lo - 1e-9) & (made[names] <= hi + 1e-9)).all().all()
    again = OS.oversample(matrix.repartition(7), cell_rows=cell_rows).where("synthetic").toPandas()
    key = ["customer_id", *names]
    a = made.sort_values(key)[names].to_numpy()
    b = again.sort_values(key)[names].to_numpy()
    assert np.allclose(a, b)
    report = OS.placement_report({"train": out, "validation": matrix}, "x").collect()
    assert {r["status"] for r in report} == {"PASS"}
    bad = OS.placement_report({"test": out}, "x").first()
    assert bad["status"] == "FAIL"


def test_cells_stay_small_with_tied_values(spark):
    pdf = pd.DataFrame({"f": [1.0] * 700 + list(np.linspace(2, 3, 300)), "k": np.arange(1000) / 1e6})
    vectors = spark.createDataFrame(pdf).selectExpr("array(f, k) AS _x")
    cells = OS.with_cells(vectors, ["f", "k"], 1000, 50)
    sizes = cells.groupBy("_cell").count().toPandas()["count"]
    assert sizes.max() <= 50 and sizes.sum() == 1000


def test_boxes_rule_out_most_pairs(spark):
    """The widest feature has two values: distance along it alone would rule nothing out."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 2, 2_000) * 20.0, rng.random((2_000, 2)) * 10])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    vectors = df.selectExpr("array(a, b, c) AS _x")
    celled = OS.with_cells(vectors, list("abc"), 2_000, 20).toPandas()
    cells = celled.groupby("_cell")["_x"].agg(list)
    low, high = (np.array([f(np.vstack(v), axis=0) for v in cells]) for f in (np.min, np.max))
    found = OS.neighbours(df, list("abc"), 5, 20).collect()
    searched = set()
    cell = {tuple(v): c for v, c in zip(celled["_x"], celled["_cell"])}
    ids = np.array(cells.index)
    for r in found:
        q = np.array(r["_x"])
        d = ((x - q) ** 2).sum(axis=1)
        assert np.allclose([n["gap"] for n in r["_near"]], np.sort(d)[1:6])
        own = np.sort(((np.vstack(cells[cell[tuple(r["_x"])]]) - q) ** 2).sum(axis=1))[1:6][-1]
        gap = (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(axis=1)
        searched |= {(cell[tuple(r["_x"])], c) for c in ids[gap <= own]}
    assert len(found) == 2_000 and len(searched) < 0.1 * len(ids) ** 2


def test_splits_are_exact_and_stable(matrix):
    rest, taken = SP.stratified_split(matrix, share=0.3)
    n = OS.class_counts(matrix)
    t = OS.class_counts(taken)
    assert all(t[c] == int(0.3 * n[c] + 0.5) for c in n)
    assert rest.join(taken, "customer_id").count() == 0
    other = SP.stratified_split(matrix.repartition(5), share=0.3)[1]
    assert {r[0] for r in taken.select("customer_id").collect()} == {
        r[0] for r in other.select("customer_id").collect()}
    folds = SP.with_folds(matrix, 3).groupBy("fold", "lapsed").count().toPandas()
    assert folds.groupby("lapsed")["count"].agg(lambda c: c.max() - c.min()).max() <= 1


@pytest.fixture(scope="module")
def trained(matrix):
    train, val = SP.stratified_split(matrix, share=0.2)
    return L.train_models(train, val, SMALL)


def test_models_beat_the_constant(trained, matrix):
    pred = trained.predict(matrix)
    table = {r["model"]: r for r in M.evaluate(pred).collect()}
    assert set(table) == set(L.MODEL_NAMES)
    for name, row in table.items():
        assert row["roc_auc"] > 0.7, name
    assert pred.where("p < 0 or p > 1 or p is null").count() == 0
    best = L.best_model(L.flag_baselines(M.evaluate(pred.unionByName(
        L.majority_baseline(matrix, matrix)).unionByName(L.random_baseline(matrix, matrix)))))
    assert best.first()["model"] in L.MODEL_NAMES
    top = L.top_features(trained.importances(matrix.sparkSession), 2).collect()
    assert len(top) == 6


def _expected(tree, x, known, at=0):
    node = tree[at]
    if node["left"] < 0:
        return node["value"]
    left, right = tree[node["left"]], tree[node["right"]]
    if node["feature"] in known:
        go = node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]
        return _expected(tree, x, known, go)
    return (left["cover"] * _expected(tree, x, known, node["left"])
            + right["cover"] * _expected(tree, x, known, node["right"])) / node["cover"]


@pytest.mark.parametrize("name", ["random_forest", "xgboost", "lightgbm"])
def test_tree_attribution_is_the_shapley_value(spark, matrix, trained, name):
    if name == "random_forest":
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/m"
        trained.models[name].write().save(path)
        nodes = AT.tree_nodes(spark, path)
    else:
        nodes = trained.models[name].nodes(spark)
    rows = matrix.limit(4)
    got = AT.tree_attribution(rows, trained.features, nodes).toPandas()
    x = rows.toPandas().set_index("customer_id")
    table = nodes.toPandas()
    trees = [(t["weight"].iloc[0], t.set_index("id").to_dict("index"))
             for _, t in table.groupby("tree")]
    d = len(trained.features)
    for _, row in got.iterrows():
        values = x.loc[row["customer_id"], trained.features].to_numpy()
        for j, f in enumerate(trained.features):
            others = [i for i in range(d) if i != j]
            want = 0.0
            for size in range(d):
                for known in combinations(others, size):
                    w = factorial(size) * factorial(d - size - 1) / factorial(d)
                    for weight, tree in trees:
                        want += w * weight * (_expected(tree, values, {*known, j})
                                              - _expected(tree, values, set(known)))
            assert row[f] == pytest.approx(want, abs=1e-9)
        p = trained.predict(rows.where(F.col("customer_id") == int(row["customer_id"])), [name]).first()["p"]
        margin = row["base_value"] + row[trained.features].sum()
        shown = margin if name == "random_forest" else 1 / (1 + np.exp(-margin))
        assert shown == pytest.approx(p, abs=1e-6)
    assert AT.dependence_pairs(
        AT.tree_attribution(rows, trained.features, nodes), rows, trained.features, 2).count() == 8


def test_linear_attribution(spark, matrix, trained):
    coef = trained.models["logistic_regression"].coefficients.toArray().tolist()
    out = AT.linear_attribution(matrix, trained.features, coef)
    assert abs(out.agg(F.sum("total_spent")).first()[0]) < 1e-6
    assert AT.mean_absolute(out, trained.features).count() == len(trained.features)


def test_ablation_groups_and_scores(matrix, spark):
    groups = AB.resolve_groups(["total_orders", "total_spent", "noise"], "rees46")
    assert groups == {"purchase": ["total_orders"], "monetary": ["total_spent"]}
    with pytest.raises(RuntimeError):
        AB.resolve_groups(["noise"], "telco")
    got = AB.match_columns(["pay_type__card", "avg_payment_value"], ["avg_payment_value", "pay_type_"])
    assert got == ["avg_payment_value", "pay_type__card"]
    table = AB.run_ablation(
        matrix, "rees46", folds=2, trees=3, models=["logistic_regression"], settings=SMALL)
    rows = {r["feature_set"]: r for r in table.collect()}
    assert set(rows) == {"all_features", "without_purchase", "without_monetary", "without_inactivity"}
    assert rows["all_features"]["mean_roc_auc"] > rows["without_inactivity"]["mean_roc_auc"]
    assert AB.dominant_group(table, "logistic_regression") in {"purchase", "monetary", "inactivity"}
    assert AB.dominant_group(table, "svm") == "unknown"
    over = AB.run_ablation(
        matrix, "rees46", folds=2, trees=3, models=["logistic_regression"], settings=SMALL,
        oversampled=True)
    assert over.count() == 4


def test_segments(matrix):
    found = SG.segment_customers(matrix.drop("lapsed"), 3)
    pdf = found.rows.toPandas()
    assert len(pdf) == 300 and pdf["segment"].nunique() == 3
    assert abs(pdf["pca_x"].mean()) < 1e-6 and -1 <= found.silhouette <= 1 and -1 <= found.silhouette_squared <= 1
    lone = SG.segment_customers(matrix.drop("lapsed").limit(1))
    assert lone.rows.first()["segment"] == 0


def _clouds(spark, n=400):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(n // 4, 3)) + 4 * rng.normal(size=3) for _ in range(4)])
    return x, spark.createDataFrame([(int(h), v.tolist()) for h, v in zip(rng.integers(0, 1 << 60, n), x)], "h long, x array<double>")


def test_the_best_of_all_starts_wins(spark):
    x, points = _clouds(spark)
    centres, inertia, each = SG.best_centres(points.repartition(4), 5, 10)
    assert len(each) == 10 and inertia == each.min()
    assert inertia == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
    # A single start with the same draws is one of the ten.
    draw = np.random.default_rng(42)
    sample = np.array([r.x for r in points.orderBy("h", "x").collect()])
    for start in range(3):
        c = SG.first_centres(sample, 5, draw)
        for _ in range(300):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(5)])
            if ((new - c) ** 2).sum() <= 1e-4 * sample.var(axis=0).mean():
                break
            c = new
        single = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert each[start] == pytest.approx(single) and inertia <= single + 1e-9


def test_distances_by_products_are_those_by_differences():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(40, 6)) + 1e4  # long vectors near each other: a product alone loses their distance
    x = np.vstack([sample[:5], sample[:5] + 1e-7, rng.normal(size=(10, 6)) - 1e4])
    want = np.sqrt(((x[:, None] - sample[None]) ** 2).sum(axis=2))
    assert np.allclose(SG._distances(x, sample), want, rtol=1e-8, atol=0)
    assert (SG._distances(x, sample)[np.arange(5), np.arange(5)] == 0).all()


def test_silhouette_equals_brute_force(spark):
    x, points = _clouds(spark, 120)
    rng = np.random.default_rng(4)
    segment = rng.integers(0, 3, len(x))
    segment[0] = 3  # alone
    rows = [(r.h, r.x) for r in points.collect()]
    marked = spark.createDataFrame([(h, v, int(s)) for (h, v), s in zip(rows, segment)], "h long, x array<double>, segment int").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(x)):
        own = (segment == segment[i]) & (np.arange(len(x)) != i)
        if not own.any():
            want.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, segment == s].mean() for s in range(4) if s != segment[i])
        want.append((b - a) / max(a, b))
    assert SG.silhouette_of(marked, 4) == pytest.approx(np.mean(want))
    assert abs(SG.silhouette_of(marked, 4, 25) - np.mean(want)) < 0.05
    assert SG.silhouette_of(marked.where("segment = 1"), 4) is None
