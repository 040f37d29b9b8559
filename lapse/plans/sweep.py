"""Many datasets, both modes, with a gate, a resume point and one status row per run."""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.operators import ablation as AB
from lapse.operators import metrics as M
from lapse.operators import profile as P
from lapse.operators.features import feature_columns
from lapse.plans import gates, probe
from lapse.plans.compare import comparison_table
from lapse.plans.run import RunResult, run_pipeline
from lapse.settings import Settings
from lapse.sources import sinks as K
from lapse.sources.registry import get_dataset, list_datasets

log = logging.getLogger("lapse")
STATUS = (
    "phase string, dataset string, status string, best_model string, lapse_rate double, "
    "imbalance double, seconds double, message string"
)
MODES = ("original", "smote")


def _status(mode: str, name: str, result: RunResult | None, seconds: float, message: str | None):
    if result is None:
        return (mode, name, "SKIP" if message is None else "FAILED", None, None, None,
                float(seconds), message)
    return (mode, name, "OK", result.best_model, round(result.lapse_rate, 4),
            round(float(result.imbalance_ratio), 2), float(result.seconds), None)


def run_many(
    spark: SparkSession, roots: Mapping[str, str], output: str | None = None,
    datasets: Sequence[str] | None = None, modes: Sequence[str] = ("original",),
    resume: bool = False, keep: bool = False, **options,
) -> tuple[DataFrame, dict[tuple[str, str], RunResult]]:
    """Run datasets mode by mode; one status row each. With ``resume`` finished runs are skipped.

    Modes of a dataset share what it is loaded, cleaned and split to. Cached frames of a run are freed when it ends, those
    that are shared after the last of its modes, unless ``keep`` asks for them.
    """
    runs = [(d, m) for m in modes for d in (datasets or list_datasets())]
    pending = K.pending_runs(spark, output, runs) if resume and output else runs
    rows, results, prepared = [], {}, {}
    left = Counter(name for name, _ in pending)
    for name, mode in runs:
        if (name, mode) not in pending:
            rows.append(_status(mode, name, None, 0.0, None))
            continue
        started = time.time()
        try:
            left[name] -= 1
            result = run_pipeline(
                spark, name, roots[name], output, use_smote=mode == "smote", prepared=prepared.get(name), **options)
            results[(name, mode)] = result
            prepared[name] = result.prepared
            if output:
                K.mark_done(spark, output, name, mode)
            if not keep:
                result.release(shared=left[name] > 0)
                if not left[name]:
                    prepared.pop(name).release()
            rows.append(_status(mode, name, result, result.seconds, None))
        except Exception as exc:
            log.warning("%s/%s failed: %s", name, mode, exc)
            rows.append(_status(mode, name, None, time.time() - started, f"{type(exc).__name__}: {exc}"))
    return spark.createDataFrame(rows, STATUS), results


def full_sweep(
    spark: SparkSession, roots: Mapping[str, str], output: str,
    datasets: Sequence[str] | None = None, settings: Settings | None = None, **options,
) -> DataFrame:
    """Gate first, then every dataset in both modes with resume; raises when the gate fails."""
    targets = list(datasets or list_datasets())
    report = gates.run_preflight(spark, roots, targets, settings=settings)
    if not gates.gate_all_passed(report):
        failed = report.where("status = 'FAIL'").collect()
        raise RuntimeError("gate failed: " + "; ".join(
            f"{r['dataset']}/{r['check']}: {r['details']}" for r in failed))
    status, _ = run_many(
        spark, roots, output, targets, MODES, resume=True, settings=settings, **options)
    return status


def mode_comparison(
    spark: SparkSession, roots: Mapping[str, str], output: str | None = None,
    datasets: Sequence[str] | None = None, include_baselines: bool = False, **options,
) -> dict[str, DataFrame]:
    """Both modes per dataset: comparison, mean AUC per dataset, calibration by mode, status.

    Datasets that fail in either mode appear in the status only.
    """
    status, results = run_many(spark, roots, output, datasets, MODES, keep=True, **options)
    tables, curves = [], []
    for name in dict.fromkeys(d for d, _ in results):
        a, b = results.get((name, "original")), results.get((name, "smote"))
        if a is None or b is None:
            continue
        tag = lambda df: df.withColumn("dataset", F.lit(name))  # noqa: B023, E731
        tables.append(comparison_table(
            tag(a.metrics), tag(b.metrics), include_baselines=include_baselines))
        curves.append(tag(M.calibration_comparison(
            a.predictions.where(F.col("p").isNotNull()),
            b.predictions.where(F.col("p").isNotNull()))))
    out = {"status": status}
    if tables:
        merged = reduce(lambda x, y: x.unionByName(y), tables)
        out["comparison"] = merged
        out["mean_auc"] = P.mean_auc_per_dataset(merged)
        out["calibration"] = reduce(lambda x, y: x.unionByName(y), curves)
        if output:
            shared = K.RunScope(output, "all").shared
            for key in ("comparison", "mean_auc", "calibration"):
                K.write_table(out[key], f"{shared}/smote_{key}")
    return out


def ablation_only(
    spark: SparkSession, name: str, root: str, output: str | None = None, use_smote: bool = False,
    settings: Settings | None = None, **options,
) -> DataFrame:
    """Ablation of a native-split dataset without a full run; refreshes only its own output."""
    s = settings or Settings()
    adapter = get_dataset(name)
    if adapter.route != "native":
        raise RuntimeError(f"ablation-only needs a native-split dataset, {name} is {adapter.route}")
    data = adapter.split(adapter.events(spark, root), s)
    train = data.train.persist()
    table = AB.run_ablation(
        train, adapter.name, s.ablation_folds, s.ablation_trees, settings=s.models,
        oversampled=use_smote, seed=s.seed, **options)
    if output:
        scope = K.RunScope(output, adapter.name, "smote" if use_smote else "original")
        K.write_table(table.coalesce(1), scope.results("ablation", "ablation_results"))
    log.info("%s: %d features", name, len(feature_columns(train)))
    train.unpersist()
    return table


def ablation_sweep(
    spark: SparkSession, roots: Mapping[str, str], output: str,
    datasets: Sequence[str] = ("credit_card", "telco"), with_smote: bool = False,
    settings: Settings | None = None, **options,
) -> DataFrame:
    """Gate, then ablation per dataset and mode; lists every result row with dataset and mode."""
    report = gates.run_preflight(spark, roots, datasets, settings=settings)
    if not gates.gate_all_passed(report):
        raise RuntimeError("gate failed; fix the FAIL rows before the ablation")
    parts = []
    for name in datasets:
        for mode in MODES if with_smote else MODES[:1]:
            table = ablation_only(
                spark, name, roots[name], output, mode == "smote", settings, **options)
            parts.append(table.withColumns({"dataset": F.lit(name), "mode": F.lit(mode)}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def probed_run(
    spark: SparkSession, name: str, root: str, output: str, settings: Settings | None = None,
    **options,
) -> DataFrame:
    """Probe, stop on a truncated label window, then both modes; returns the status rows."""
    adapter = get_dataset(name)
    report = probe.sanity_probe(spark, adapter, root, settings)
    K.save_json(report, f"{output.rstrip('/')}/results/{name}/preflight/sanity_probe")
    row = probe.require_observed(report).first()
    if row["extreme_rate"]:
        log.warning("%s: extreme lapse rate, review the label window", name)
    status, _ = run_many(
        spark, {name: root}, output, [name], MODES, resume=True, settings=settings, **options)
    return status
