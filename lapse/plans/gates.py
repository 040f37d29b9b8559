"""Checks to pass before a sweep starts: inputs, cohorts, ablation groups, temporal validity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.functions import timing as tm
from lapse.operators import ablation as AB
from lapse.operators import assemble as A
from lapse.operators import labels as L
from lapse.operators import oversample as OS
from lapse.operators.features import feature_columns
from lapse.operators.splits import stratified_split
from lapse.schema import TIME
from lapse.settings import Settings
from lapse.sources.adapter import Adapter
from lapse.sources.registry import expected_inputs, get_dataset

SCHEMA = "stage string, dataset string, check string, status string, details string"
EXPECTED_EVENT_TYPES = ("view", "cart_add", "purchase")
DEFAULT_TARGETS = ("olist", "retailrocket", "credit_card", "telco")


def _rows(spark: SparkSession, stage: str, dataset: str, entries) -> DataFrame:
    return spark.createDataFrame(
        [(stage, dataset, c, s if isinstance(s, str) else "PASS" if s else "FAIL", d)
         for c, s, d in entries], SCHEMA)


def cohort_gate(
    events: DataFrame, dataset: str, window: int, groups: Sequence[str] | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """User-disjoint split: sizes, cutoffs, event counts, rates, overlap and matrix checks."""
    s = settings or Settings()
    spark = events.sparkSession
    cohorts = L.disjoint_cohorts(events, window, s.train_quantile)
    r = L.cohort_summary(cohorts).first()
    users = lambda k: f"{r['n_' + k]} users ({100 * r[k + '_share']:.1f}%)"
    inside = lambda v: v is not None and 0.0 < v < 1.0
    percent = lambda v: "none" if v is None else f"{100 * v:.2f}%"
    entries = [
        ("raw_users", True, f"{r['n_raw']} users"),
        ("train_users", True, users("train")),
        ("test_users", True, users("test")),
        ("excluded_users", r["n_excluded"] >= 0, users("excluded")),
        ("train_cutoff", True, f"{cohorts.cutoffs.train:%Y-%m-%d %H:%M:%S}"),
        ("test_snapshot", True, f"{cohorts.cutoffs.test:%Y-%m-%d %H:%M:%S}"),
        ("train_events", True, f"{r['train_events']} before the cutoff"),
        ("test_events", True, f"{r['test_events']} before the snapshot"),
        ("train_label_events", True, f"{r['train_label_events']} inside the window"),
        ("test_label_events", True, f"{r['test_label_events']} inside the window"),
        ("lapse_train", inside(r["lapse_train"]), percent(r["lapse_train"])),
        ("lapse_test", inside(r["lapse_test"]), percent(r["lapse_test"])),
    ]
    table = A.disjoint_table(events, cohorts, groups).persist()
    try:
        sizes = A.split_sizes(table)
        shared = sizes.first()["n_shared"]
        entries.append(("zero_user_overlap", shared == 0, f"{shared} shared users"))
        try:
            L.check_cohorts(sizes, s.min_train_users, s.min_test_users)
            n = sizes.first()
            width = len(feature_columns(table))
            entries.append((
                "feature_matrices", True,
                f"train ({n['n_train']}, {width}), test ({n['n_test']}, {width})"))
        except ValueError as exc:
            entries.append(("feature_matrices", False, str(exc)))
    finally:
        table.unpersist()
    return _rows(spark, "uds", dataset, entries)


def ablation_gate(
    train: DataFrame, dataset: str, declared: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Every resolved group removes columns, coverage, and both classes present."""
    spark = train.sparkSession
    names = feature_columns(train)
    try:
        groups = AB.resolve_groups(names, dataset, declared)
    except RuntimeError as exc:
        return _rows(spark, "ablation", dataset, [("group_resolution", False, str(exc))])
    covered = {c for cols in groups.values() for c in cols}
    entries = [
        (f"group:{g}", len(cols) > 0, f"{len(cols)} of {len(names)} columns removed")
        for g, cols in groups.items()
    ]
    share = 100.0 * len(covered) / len(names)
    entries.append(("coverage", bool(covered), f"{len(covered)}/{len(names)} ({share:.1f}%)"))
    found = sorted(r[L.LABEL] for r in train.select(L.LABEL).distinct().collect())
    entries.append(("label_both_classes", {0, 1} <= set(found), f"classes {found}"))
    return _rows(spark, "ablation", dataset, entries)


def temporal_gate(
    events: DataFrame, dataset: str, window: int, expected_window: int = 90,
    native_label: bool = False, q: float = 0.7, declared: Sequence[str] = (),
) -> DataFrame:
    """Span, observed label windows, window length, event types, no native label columns."""
    spark = events.sparkSession
    span = events.agg(tm.floor_days(F.max(TIME), F.min(TIME)).alias("d")).first()["d"]
    cut = L.global_cutoffs(events, window, q)
    observed = lambda at: cut.last_event >= tm.plus_days(at, window)
    if "event_type" in events.columns:
        wanted = spark.createDataFrame([(t,) for t in EXPECTED_EVENT_TYPES], "event_type string")
        missing = sorted(
            r[0] for r in wanted.subtract(events.select("event_type").distinct()).collect())
    else:
        missing = ["event_type column"]
    leaked = L.label_like(events.columns, declared)
    return _rows(spark, "temporal", dataset, [
        ("data_span", (span or 0) > 0, f"{span} days"),
        ("train_label_window_observed", observed(cut.train), f"cutoff {cut.train:%Y-%m-%d} + {window} d"),
        ("test_label_window_observed", observed(cut.test), f"cutoff {cut.test:%Y-%m-%d} + {window} d"),
        ("label_window", window == expected_window, f"configured {window} days"),
        ("event_type_coverage", not missing, f"missing {missing or 'none'}"),
        ("native_label_columns_absent", not leaked, f"leaked {leaked or 'none'}"),
        ("uses_native_label", not native_label, f"{native_label}"),
    ])


def smote_gate(
    dataset: str, train: DataFrame, test: DataFrame, settings: Settings | None = None
) -> DataFrame:
    """Oversample the training fold and count synthetic rows everywhere."""
    s = settings or Settings()
    rows, validation = stratified_split(
        train, L.LABEL, s.validation_share, seed=s.seed, salt="validation")
    made = OS.oversample(rows, seed=s.seed)
    return OS.placement_report({"train": made, "validation": validation, "test": test}, dataset)


def dataset_gate(
    spark: SparkSession, adapter: Adapter, root: str, settings: Settings | None = None,
    include_smote: bool = True,
) -> DataFrame:
    """The deep checks that apply to one dataset; a load failure becomes a FAIL row."""
    s = settings or Settings()
    try:
        events = adapter.events(spark, root).persist()
        parts = []
        if adapter.route == "user_disjoint":
            parts.append(cohort_gate(events, adapter.name, adapter.window(s), adapter.groups, s))
        if adapter.hard_checks:
            parts.append(temporal_gate(
                events, adapter.name, adapter.window(s), native_label=adapter.native_label,
                q=s.train_quantile, declared=adapter.label_columns))
        if adapter.route == "native" or include_smote:
            data = adapter.split(events, s)
            if adapter.route == "native":
                parts.append(ablation_gate(data.train, adapter.name))
            if include_smote:
                parts.append(smote_gate(adapter.name, data.train, data.test, s))
        events.unpersist()
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else _rows(
            spark, "data", adapter.name, [("deep", "NA", "no deep check applies")])
    except Exception as exc:
        return _rows(spark, "data", adapter.name, [("load", False, f"{type(exc).__name__}: {exc}")])


def run_preflight(
    spark: SparkSession, roots: Mapping[str, str], targets: Sequence[str] | None = None,
    include_smote: bool = True, settings: Settings | None = None,
) -> DataFrame:
    """stage, dataset, check, status (PASS, FAIL, NA), details for every target."""
    names = [t.lower().strip() for t in (targets or DEFAULT_TARGETS)]
    inputs = expected_inputs(spark, names, dict(roots))
    failed = {r["dataset"] for r in inputs.where("status = 'FAIL'").select("dataset").collect()}
    parts = [inputs]
    for name in names:
        if name in failed:
            parts.append(_rows(spark, "data", name, [
                ("deep", "NA", "input missing, deep checks skipped")]))
        else:
            parts.append(dataset_gate(
                spark, get_dataset(name), roots.get(name, ""), settings, include_smote))
    return reduce(lambda a, b: a.unionByName(b), parts)


def gate_all_passed(report: DataFrame) -> bool:
    return report.where(F.col("status") == "FAIL").isEmpty()
