"""Workflows over a native-split dataset read from CSV."""

import random

import pytest

from lapse.plans import gates, sweep
from lapse.settings import ModelSettings, Settings
from lapse.sources import sinks as K

FEW = ModelSettings(lr_max_iter=10, rf_trees=2, rf_depth=2, gbt_rounds=1, gbt_depth=2, boost2_rounds=1)
SHORT = Settings(models=FEW, ablation_trees=2, ablation_folds=2)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("telco")
    rng = random.Random(4)
    rows = ["customerID,gender,SeniorCitizen,Partner,tenure,Contract,PaymentMethod,MonthlyCharges,TotalCharges,Churn"]
    for i in range(160):
        gone = rng.random() < 0.3
        tenure = rng.randint(1, 20) if gone else rng.randint(10, 70)
        rows.append(
            f"c{i},{rng.choice(['Male', 'Female'])},{rng.randint(0, 1)},{rng.choice(['Yes', 'No'])},{tenure},"
            f"{'Month-to-month' if gone else rng.choice(['One year', 'Two year', 'Month-to-month'])},"
            f"{rng.choice(['card', 'check'])},{rng.uniform(20, 100):.2f},{tenure * 30.0:.1f},"
            f"{'Yes' if gone else 'No'}")
    (folder / "customers.csv").write_text("\n".join(rows) + "\n")
    return str(folder)


def test_gate_passes(spark, root):
    report = gates.run_preflight(spark, {"telco": root}, ["telco"], settings=SHORT)
    assert gates.gate_all_passed(report)
    checks = {r["check"] for r in report.collect()}
    assert {"group:contract", "coverage", "label_both_classes", "train_only_placement:test"} <= checks


def test_ablation_sweep(spark, root, tmp_path):
    out = str(tmp_path / "out")
    table = sweep.ablation_sweep(
        spark, {"telco": root}, out, ["telco"], with_smote=True, settings=SHORT,
        models=["logistic_regression"])
    rows = table.collect()
    assert {r["mode"] for r in rows} == {"original", "smote"}
    assert {r["feature_set"] for r in rows} == {
        "all_features", "without_contract", "without_usage_charges", "without_billing",
        "without_demographics"}
    saved = K.read_table(spark, K.RunScope(out, "telco", "smote").results("ablation", "ablation_results"))
    assert saved.count() == 5


def test_full_sweep_runs_both_modes_once(spark, root, tmp_path):
    out = str(tmp_path / "out")
    options = dict(settings=SHORT, models=("logistic_regression",), steps=())
    first = sweep.full_sweep(spark, {"telco": root}, out, ["telco"], **options)
    assert {(r["phase"], r["status"]) for r in first.collect()} == {("original", "OK"), ("smote", "OK")}
    again = sweep.full_sweep(spark, {"telco": root}, out, ["telco"], **options)
    assert {r["status"] for r in again.collect()} == {"SKIP"}


def test_ablation_only_needs_a_native_split(spark, root):
    with pytest.raises(RuntimeError, match="native-split"):
        sweep.ablation_only(spark, "olist", root)


def test_modes_share_one_load(spark, root, monkeypatch):
    from lapse.plans.sweep import MODES, run_many
    from lapse.sources import adapters

    calls, load = [], adapters.Labelled.load
    monkeypatch.setattr(adapters.Labelled, "load", lambda self, *a: (calls.append(self.name), load(self, *a))[1])
    status, results = run_many(
        spark, {"telco": root}, None, ["telco"], MODES, settings=SHORT, steps=(), models=("logistic_regression",))
    assert [r["status"] for r in status.collect()] == ["OK", "OK"] and calls == ["telco"]
    a, b = (results[("telco", m)] for m in MODES)
    assert a.data is b.data and a.metrics.count() == b.metrics.count()
