"""Sanity probe of an event dataset before any model is fitted."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.functions import timing as tm
from lapse.operators import assemble as A
from lapse.operators import labels as L
from lapse.operators.clean import align_columns
from lapse.operators.features import POINT, feature_columns
from lapse.operators.splits import sample_rows
from lapse.schema import CUSTOMER, TIME, conform
from lapse.settings import Settings
from lapse.sources.adapter import Adapter
from lapse.sources.registry import adapter_inputs


def _counts(df: DataFrame) -> dict:
    return {
        str(r["event_type"]): r["n"]
        for r in df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).collect()
    }


def sanity_probe(
    spark: SparkSession, adapter: Adapter, root: str, settings: Settings | None = None,
    sample_customers: int | None = None,
) -> DataFrame:
    """One report row: files, counts, types, span, cutoffs, rates, matrix shape, passed checks.

    The probe matrix is built for everyone; ``sample_customers`` builds it for a sample instead. A failed temporal check raises.
    """
    started = time.time()
    s = settings or Settings()
    window = adapter.window(s)
    files = adapter_inputs(spark, [adapter], {adapter.name: root}).collect()
    raw = adapter.load(spark, root)
    cleaned = adapter.clean(raw)
    events = conform(adapter.standard(cleaned)).persist()
    span = events.agg(
        tm.floor_days(F.max(TIME), F.min(TIME)).alias("days"),
        F.date_format(F.min(TIME), "yyyy-MM-dd HH:mm:ss").alias("first"),
        F.date_format(F.max(TIME), "yyyy-MM-dd HH:mm:ss").alias("last"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    cut = L.global_cutoffs(events, window, s.train_quantile)
    points = [
        L.LabelPoint("train", cut.train, window), L.LabelPoint("test", cut.test, window)]
    labels = L.labels_at(events, points).persist()
    rates = {r["point"]: r for r in L.label_summary(labels, ["point"]).collect()}

    picked = labels.select(CUSTOMER).distinct()
    if sample_customers:
        picked = sample_rows(picked, sample_customers, [CUSTOMER], s.seed)
    matrix = A.feature_matrix(
        events, {p.name: p.snapshot for p in points}, adapter.groups, customers=picked)
    table = A.join_labels(matrix, labels)
    side = lambda n: table.where(F.col(POINT) == n).drop(POINT)
    train, test = align_columns(side("train"), side("test"))
    checks = L.assert_checks(L.temporal_checks(events, cut, labels, feature_columns(train)))
    rate = lambda n, c: rates[n][c] if n in rates else None
    extreme = any(r["extreme_rate"] for r in rates.values())
    row = {
        "dataset": adapter.name,
        "files_present": [f["check"] for f in files if f["status"] == "PASS"],
        "files_missing": [f["check"] for f in files if f["status"] != "PASS"],
        "n_events_raw": raw.count(),
        "raw_columns": raw.columns,
        "n_events_preprocessed": span["n"],
        "event_type_counts_raw": _counts(raw) if "event_type" in raw.columns else {},
        "event_type_counts_mapped": _counts(events) if "event_type" in events.columns else {},
        "first_event": span["first"], "last_event": span["last"], "span_days": span["days"],
        "train_cutoff": f"{cut.train:%Y-%m-%d %H:%M:%S}",
        "test_cutoff": f"{cut.test:%Y-%m-%d %H:%M:%S}",
        "train_label_window_observed": cut.last_event >= points[0].end,
        "test_label_window_observed": cut.last_event >= points[1].end,
        "lapse_rate_train": rate("train", "lapse_rate"),
        "lapse_rate_test": rate("test", "lapse_rate"),
        "n_train_customers": rate("train", "n_total"),
        "n_test_customers": rate("test", "n_total"),
        "sample_rows_train": train.count(), "sample_rows_test": test.count(),
        "feature_columns": feature_columns(train),
        "validity_checks": checks,
        "extreme_rate": extreme,
        "duration_sec": round(time.time() - started, 2),
    }
    labels.unpersist()
    events.unpersist()
    schema = (
        "dataset string, files_present array<string>, files_missing array<string>, "
        "n_events_raw bigint, raw_columns array<string>, n_events_preprocessed bigint, "
        "event_type_counts_raw map<string,bigint>, event_type_counts_mapped map<string,bigint>, "
        "first_event string, last_event string, span_days bigint, train_cutoff string, "
        "test_cutoff string, train_label_window_observed boolean, "
        "test_label_window_observed boolean, lapse_rate_train double, lapse_rate_test double, "
        "n_train_customers bigint, n_test_customers bigint, sample_rows_train bigint, "
        "sample_rows_test bigint, feature_columns array<string>, validity_checks array<string>, "
        "extreme_rate boolean, duration_sec double"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


def require_observed(report: DataFrame) -> DataFrame:
    """Stop when a label window is truncated; extreme rates only stay visible in the report."""
    row = report.first()
    if not (row["train_label_window_observed"] and row["test_label_window_observed"]):
        raise RuntimeError("label window not fully observed; inactivity labels would be truncated")
    return report
