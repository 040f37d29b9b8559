import pytest
from pyspark.sql import functions as F

from lapse.operators import checks as V
from lapse.operators import labels as L
from lapse.operators import profile as P
from lapse.plans import cli, gates, probe, sweep
from lapse.plans.run import run_pipeline
from lapse.settings import ModelSettings, Settings
from lapse.sources import driver as D
from lapse.sources import driver_adapters as DA
from lapse.sources import sinks as K
from lapse.sources.registry import register_dataset

FEW = ModelSettings(
    lr_max_iter=20, rf_trees=3, rf_depth=3, gbt_rounds=2, gbt_depth=2, boost2_rounds=2,
    svm_max_iter=5, svm_folds=2)
SHORT = Settings(models=FEW, ablation_trees=2, ablation_folds=2, bootstrap_replicates=20,
                 attribution_rows=30)


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("out"))


@pytest.fixture(scope="module")
def run(spark, sf_dir, out):
    return run_pipeline(spark, DA.STAR_ORDERS, sf_dir, out, SHORT)


def test_run_writes_everything(spark, run, out):
    assert run.skipped == {}
    assert run.best_model in ("logistic_regression", "random_forest", "xgboost", "lightgbm", "svm")
    models = {r["model"] for r in run.metrics.collect()}
    assert len(models) == 7 and "majority_class" in models
    missing = run.tables["outputs"].where("check = 'artefact' and level <> 'ok'")
    assert missing.count() == 0
    scope = K.RunScope(out, "star_orders")
    assert K.read_table(spark, scope.processed("train_features")).count() > 0
    log = K.read_table(spark, scope.results("experiments", "log")).first().asDict()
    assert log["dataset"] == "star_orders" and log["schema_errors"] == 0
    risk = K.read_table(spark, scope.results("risk_scoring", run.best_model))
    assert risk.where("risk_percentile > 100 or risk_percentile <= 0").count() == 0
    svm = K.load_svm(spark, scope.models("svm"))
    assert len(svm.folds) == 2


def test_master_keeps_other_datasets(spark, run, out):
    scope = K.RunScope(out, "other")
    rows = K.master_rows(run.metrics, "other", "x", 0.5, 1.0, "purchase")
    K.upsert_master(scope, rows, ["other"])
    K.upsert_master(scope, rows, ["other"])
    master = K.read_table(spark, scope.master)
    counts = {r["dataset"]: r["n"] for r in master.groupBy("dataset").agg(F.count("*").alias("n")).collect()}
    assert counts == {"star_orders": 7, "other": 7}
    bad = K.upsert_master(scope, rows.drop("f1"), ["other"])
    assert bad.first()["check"] == "missing_column:f1"


def test_smote_run_on_disjoint_route(spark, sf_dir):
    s = Settings(models=FEW, min_train_users=10, min_test_users=5)
    result = run_pipeline(
        spark, DA.STAR_SHIPMENTS, sf_dir, settings=s, use_smote=True,
        models=("logistic_regression",), steps=("tests",))
    assert result.mode == "smote" and result.data.route == "user_disjoint"
    placed = {r["check"]: r["status"] for r in result.tables["smote_placement"].collect()}
    assert set(placed.values()) == {"PASS"}
    shared = result.data.train.join(result.data.test, "customer_id").count()
    assert shared == 0


def test_schema_error_stops_the_run(spark, sf_dir):
    class Broken(DA.StarClicks):
        def clean(self, raw):
            return raw.withColumn("user_id", F.when(F.col("user_id") > 3, F.col("user_id")))

    broken = Broken("broken", "x", 1, ("purchase",))
    with pytest.raises(RuntimeError, match="null_ids"):
        run_pipeline(spark, broken, sf_dir, settings=SHORT)


def test_disjoint_cohort_properties(spark, sf_dir):
    events = D.shipment_events(spark, sf_dir)
    cohorts = L.disjoint_cohorts(events, 180)
    row = L.cohort_summary(cohorts).first()
    assert row["n_train"] + row["n_test"] + row["n_excluded"] == row["n_raw"]
    assert row["train_share"] + row["test_share"] + row["excluded_share"] == pytest.approx(1.0)
    with pytest.raises(ValueError, match="too small"):
        L.check_cohorts(spark.createDataFrame(
            [(1, 1, 0, 0.5, 0.5)], "n_train int, n_test int, n_shared int, lapse_train double, lapse_test double"))


def test_gates(spark, sf_dir, tmp_path):
    report = gates.dataset_gate(spark, DA.STAR_SUBSCRIBERS, sf_dir, SHORT)
    status = {(r["stage"], r["check"]): r["status"] for r in report.collect()}
    assert status[("ablation", "group_resolution")] == "FAIL"  # its columns match no declared group
    assert status[("smote", "train_only_placement:test")] == "PASS"
    missing = gates.run_preflight(spark, {"telco": str(tmp_path)}, ["telco"])
    rows = {(r["stage"], r["status"]) for r in missing.collect()}
    assert rows == {("inputs", "FAIL"), ("data", "NA")} and not gates.gate_all_passed(missing)


def test_probe_and_json(spark, sf_dir, tmp_path):
    report = probe.sanity_probe(spark, DA.STAR_CLICKS, sf_dir)
    row = probe.require_observed(report).first()
    assert row["n_events_raw"] == row["n_events_preprocessed"] == 1000
    assert set(row["event_type_counts_raw"]) == {"view", "click", "signup", "purchase", "error"}
    path = K.save_json(report, str(tmp_path / "probe"))
    assert spark.read.json(path).first()["dataset"] == "star_clicks"


def test_sweep_resumes_and_compares(spark, sf_dir, tmp_path):
    register_dataset(DA.STAR_SUBSCRIBERS)
    register_dataset(DA.StarOrders("gone", "x", 1, ("purchase",)))
    out = str(tmp_path / "sweep")
    options = dict(settings=SHORT, models=("logistic_regression",), steps=())
    roots = {"star_subscribers": sf_dir, "gone": str(tmp_path / "nowhere")}
    tables = sweep.mode_comparison(spark, roots, out, list(roots), **options)
    status = {(r["dataset"], r["phase"]): r["status"] for r in tables["status"].collect()}
    assert status[("star_subscribers", "smote")] == "OK" and status[("gone", "original")] == "FAILED"
    row = tables["comparison"].collect()
    assert len(row) == 1
    assert row[0]["auc_change"] == pytest.approx(row[0]["smote_auc"] - row[0]["original_auc"])
    again, _ = sweep.run_many(spark, roots, out, ["star_subscribers"], resume=True, **options)
    assert again.first()["status"] == "SKIP"


def test_cli_preflight_exit_code(spark, tmp_path):
    assert cli.main(["preflight", "--root", str(tmp_path), "--targets", "telco"], spark) == 1


def test_layers_flag_bad_inputs(spark):
    m = spark.createDataFrame(
        [("a", 0.99, float("inf")), ("b", None, 0.1)], "model string, roc_auc double, f1 double")
    got = {(r["check"], r["subject"]) for r in V.metric_report(m, "d").collect()}
    assert got == {("high_auc", "a"), ("infinite_metric", "a:f1"), ("null_metric", "b:roc_auc")}
    pred = spark.createDataFrame(
        [("a", 0.5), ("a", 0.5), ("b", None), ("c", 0.1), ("c", None), ("c", 0.2)],
        "model string, p double")
    got = {(r["check"], r["subject"]) for r in V.probability_report(pred, "d", ["a", "b", "c", "z"]).collect()}
    assert got == {("constant_probabilities", "a"), ("empty_probabilities", "b"),
                   ("null_probabilities", "c"), ("empty_probabilities", "z")}
    empty = spark.createDataFrame([], "customer_id int, event_time timestamp")
    levels = {r["check"]: r["level"] for r in V.schema_report(empty, "d", []).collect()}
    assert levels["time_span_days"] == "warning" and levels["null_ids"] == "ok"
    gone = V.schema_report(empty.drop("event_time"), "d", [])
    assert V.report_failures(gone).first()["subject"] == "event_time"


def test_quality_report(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (1, 1.0, None), (2, 2.0, 4.0), (3, 1000.0, 5.0), (4, 3.0, 1.0)],
        "customer_unique_id int, price double, review_score double")
    got = {r["metric"]: r["value"] for r in P.quality_report(df, customer="customer_unique_id").collect()}
    assert got["duplicate_rows"] == "1" and got["price_outliers_iqr"] == "1"
    assert got["missing:review_score"] == "2" and got["unique_customers"] == "4"
    assert got["review_score_mean"] == "3.33"
