"""Classification metrics, curves, calibration and threshold tables, as aggregates.

Predictions are long: key columns (model, dataset, mode, ...), ``y`` (0/1), ``p`` (score or null) and
``yhat`` (0/1). Every score-ordered metric works on counts per distinct score and their running
totals, so rows are never ranked one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.operators import order_stats as O

KEYS = ("model",)


def linspace(start: float, stop: float, n: int) -> list[float]:
    """Evenly spaced values, computed as start + i x step with the exact end point."""
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def prediction_counts(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positives and negatives per distinct (score, prediction): all that any metric needs.

    It is the only aggregate over the predictions; its shuffle is shared by everything built on it.
    """
    y = F.col("y")
    yhat = F.col("yhat") if "yhat" in pred.columns else F.lit(None).cast("int").alias("yhat")
    return pred.groupBy(*keys, "p", yhat).agg(
        S.count_where(y == 1).alias("n_pos"), S.count_where(y == 0).alias("n_neg")
    )


def score_counts(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positives and negatives per distinct score."""
    counts = pred if "n_pos" in pred.columns else prediction_counts(pred, keys)
    return counts.where(F.col("p").isNotNull()).groupBy(*keys, "p").agg(
        F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg")
    )


def running_counts(
    pred: DataFrame, keys: Sequence[str] = KEYS, row_limit: int = O.GROUP_ROW_LIMIT,
    max_rows: int | None = None,
) -> DataFrame:
    """:func:`score_counts` plus counts at or below each score and the group totals.

    ``max_rows`` is a proven bound on the rows per key; small groups skip the search for hot ones.
    """
    counts = score_counts(pred, keys)
    groups = O.slice_groups(counts, keys, "p", row_limit=row_limit, max_rows_per_key=max_rows)
    running = O.running_and_group_totals(groups, ["n_pos", "n_neg"])
    return running.withColumnsRenamed({"all_n_pos": "pos", "all_n_neg": "neg"})


def _u_statistic() -> Column:
    """Sum over positives of negatives below plus half the tied ones."""
    below = F.col("run_n_neg") - F.col("n_neg")
    return F.sum(F.col("n_pos") * (below + F.lit(0.5) * F.col("n_neg")))


def ranking_metrics(
    pred: DataFrame, keys: Sequence[str] = KEYS, row_limit: int = O.GROUP_ROW_LIMIT,
    max_rows: int | None = None,
) -> DataFrame:
    """roc_auc (ties count half) and avg_precision (step sum); null when a class is missing."""
    running = running_counts(pred, keys, row_limit, max_rows)
    # At or above a score: totals minus what lies strictly below.
    tp = F.col("pos") - F.col("run_n_pos") + F.col("n_pos")
    fp = F.col("neg") - F.col("run_n_neg") + F.col("n_neg")
    step = F.col("n_pos") * tp / (tp + fp)
    out = running.groupBy(*keys).agg(
        _u_statistic().alias("_u"), F.sum(step).alias("_steps"),
        F.max("pos").alias("_pos"), F.max("neg").alias("_neg"),
    )
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return out.select(
        *keys,
        F.when(both, F.col("_u") / (F.col("_pos").cast("double") * F.col("_neg"))).alias("roc_auc"),
        F.when(F.col("_pos") > 0, F.col("_steps") / F.col("_pos")).alias("avg_precision"),
    )


def _f1(precision: Column, recall: Column) -> Column:
    return S.ratio(F.lit(2.0) * precision * recall, precision + recall)


def confusion(pred: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 (0 on empty denominators) and Brier score."""
    counts = pred if "n_pos" in pred.columns else prediction_counts(pred, keys)
    yhat, p = F.col("yhat"), F.col("p")
    pos, neg = F.col("n_pos"), F.col("n_neg")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    scored = F.when(p.isNotNull(), pos + neg)
    cells = counts.groupBy(*keys).agg(
        F.sum(pos + neg).alias("n_test"), F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"),
        total(neg, yhat == 0).alias("tn"), total(neg, yhat == 1).alias("fp"),
        total(pos, yhat == 0).alias("fn"), total(pos, yhat == 1).alias("tp"),
        (F.sum(pos * (p - 1) * (p - 1) + neg * p * p) / F.sum(scored)).alias("brier_score"),
    )
    precision = S.ratio("tp", F.col("tp") + F.col("fp"))
    recall = S.ratio("tp", F.col("tp") + F.col("fn"))
    return cells.select(
        *keys, "n_test", "n_pos", "n_neg",
        S.ratio(F.col("tp") + F.col("tn"), "n_test").alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), _f1(precision, recall).alias("f1"),
        "brier_score", "tn", "fp", "fn", "tp",
    )


def calibration_error(
    pred: DataFrame, keys: Sequence[str] = KEYS, bins: int = 10
) -> DataFrame:
    """Expected calibration error over left-closed bins.

    A score of exactly 1.0 lies past the last bin: it enters no bin but stays in the row count.
    """
    edges = linspace(0.0, 1.0, bins + 1)
    counts = pred if "n_pos" in pred.columns else prediction_counts(pred, keys)
    scored = counts.where(F.col("p").isNotNull())
    binned = scored.withColumn("_bin", S.edges_passed("p", edges, inclusive=True) - 1)
    n = F.col("n_pos") + F.col("n_neg")
    cells = binned.groupBy(*keys, "_bin").agg(
        F.sum(n).alias("_n"), F.sum("n_pos").alias("_y"), F.sum(F.col("p") * n).alias("_p")
    )
    inside = (F.col("_bin") >= 0) & (F.col("_bin") < bins)
    gap = F.when(inside, F.abs(F.col("_y") - F.col("_p"))).otherwise(0.0)
    return cells.groupBy(*keys).agg((F.sum(gap) / F.sum("_n")).alias("calibration_error"))


METRIC_COLUMNS = (
    "n_test", "n_pos", "n_neg", "accuracy", "precision", "recall", "f1", "roc_auc",
    "avg_precision", "brier_score", "calibration_error", "tn", "fp", "fn", "tp",
)


def evaluate(
    pred: DataFrame, keys: Sequence[str] = KEYS, bins: int = 10,
    row_limit: int = O.GROUP_ROW_LIMIT, max_rows: int | None = None,
) -> DataFrame:
    """The full metric table, one row per key; score metrics are null without scores.

    ``pred`` may be counts (:func:`prediction_counts`). Three aggregates read it: a frame whose scores cost more than a scan
    is materialised before, or all models score every row three times.
    """
    keys = list(keys)
    counts = pred if "n_pos" in pred.columns else prediction_counts(pred, keys)
    table = confusion(counts, keys)
    for extra in (
        ranking_metrics(counts, keys, row_limit, max_rows), calibration_error(counts, keys, bins)
    ):
        table = table.join(extra, keys, "left")
    return table.select(*keys, *METRIC_COLUMNS)


def threshold_table(
    pred: DataFrame, keys: Sequence[str] = KEYS, n: int = 50,
    low: float = 0.01, high: float = 0.99,
) -> DataFrame:
    """Precision, recall and F1 at evenly spaced thresholds.

    Rows are counted by how many thresholds they reach, so one aggregate serves every threshold and
    the cumulative part works on at most n + 1 rows per key.
    """
    cuts = linspace(low, high, n)
    scored = pred.where(F.col("p").isNotNull())
    reached = scored.withColumn("_reached", S.edges_passed("p", cuts, inclusive=True))
    cells = reached.groupBy(*keys, "_reached").agg(
        S.count_where(F.col("y") == 1).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    steps = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)]
    )
    spread = cells.withColumn("_step", F.explode(steps))
    hit = F.col("_reached") > F.col("_step.i")
    table = spread.groupBy(*keys, F.col("_step.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, F.col("_n")).otherwise(0)).alias("_called"),
        F.sum("_pos").alias("_all"),
    )
    precision, recall = S.ratio("_tp", "_called"), S.ratio("_tp", "_all")
    return table.select(
        *keys, "threshold", precision.alias("precision"), recall.alias("recall"),
        _f1(precision, recall).alias("f1"),
    )


# ------------------------------------------------------------------------------------- curves


def roc_points(
    pred: DataFrame, keys: Sequence[str] = KEYS, drop_collinear: bool = True,
    row_limit: int = O.GROUP_ROW_LIMIT,
) -> DataFrame:
    """threshold, fpr, tpr from the strictest threshold down, with the (0, 0) start point.

    ``drop_collinear`` leaves out points on a straight segment: those whose step equals the next one.
    """
    running = running_counts(pred, keys, row_limit)
    if drop_collinear:
        groups = O.slice_groups(
            running.withColumn("_step", F.struct("n_pos", "n_neg")), keys, "p", row_limit=row_limit
        )
        linked = O.previous_value(groups, "_step", "_lower")
        first = F.col("run_n_pos") + F.col("run_n_neg") == F.col("pos") + F.col("neg")
        last = F.col("_lower").isNull()
        running = linked.where(last | first | (F.col("_step") != F.col("_lower")))
    fp = F.col("neg") - F.col("run_n_neg") + F.col("n_neg")
    tp = F.col("pos") - F.col("run_n_pos") + F.col("n_pos")
    points = running.select(
        *keys, F.col("p").alias("threshold"),
        S.ratio(fp, "neg", None).alias("fpr"), S.ratio(tp, "pos", None).alias("tpr"),
    )
    start = pred.select(*keys).distinct() if keys else pred.select(F.lit(1).alias("_x")).limit(1)
    start = start.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(start)


def pr_points(
    pred: DataFrame, keys: Sequence[str] = KEYS, row_limit: int = O.GROUP_ROW_LIMIT
) -> DataFrame:
    """threshold, precision, recall per distinct score, plus the (1, 0) end point."""
    running = running_counts(pred, keys, row_limit)
    tp = F.col("pos") - F.col("run_n_pos") + F.col("n_pos")
    fp = F.col("neg") - F.col("run_n_neg") + F.col("n_neg")
    points = running.select(
        *keys, F.col("p").alias("threshold"), (tp / (tp + fp)).alias("precision"),
        F.coalesce(S.ratio(tp, "pos", None), F.lit(1.0)).alias("recall"),
    )
    end = pred.select(*keys).distinct() if keys else pred.select(F.lit(1).alias("_x")).limit(1)
    end = end.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


# -------------------------------------------------------------------------------- calibration


def _calibration_cells(pred: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """Counts and score sums per right-closed bin."""
    inner = linspace(0.0, 1.0, bins + 1)[1:-1]
    scored = pred.where(F.col("p").isNotNull())
    binned = scored.withColumn("bin", S.edges_passed("p", inner, inclusive=False))
    return binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.sum("p").alias("p_sum")
    )


def calibration_curve(pred: DataFrame, keys: Sequence[str] = KEYS, bins: int = 10) -> DataFrame:
    """Observed rate and mean score per non-empty bin."""
    return _calibration_cells(pred, keys, bins).select(
        *keys, "bin", "n",
        (F.col("n_pos") / F.col("n")).alias("prob_true"),
        (F.col("p_sum") / F.col("n")).alias("prob_pred"),
    )


def calibration_band(
    pred: DataFrame, keys: Sequence[str] = KEYS, bins: int = 10, replicates: int = 200,
    seed: int = 42, level: float = 0.95,
) -> DataFrame:
    """Calibration curve with a bootstrap band of the observed rate, aligned by bin.

    Resampling rows only changes how many positives and negatives fall into each bin, so a replicate
    is one multinomial draw over the counted cells: the same distribution as resampling every row,
    at the cost of one aggregate. A bin that is empty in a replicate is left out of its quantiles.
    """
    import numpy as np

    cells = _calibration_cells(pred, keys, bins)
    table = cells.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("bin", "n", "n_pos", "p_sum"))).alias("cells")
    )
    key_fields = [f for f in table.schema.fields if f.name in keys]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields]
        + ["bin int", "n bigint", "prob_true double", "prob_pred double",
           "lower double", "upper double"]
    )
    tail = (1.0 - level) / 2 * 100
    key_names = list(keys)

    def draw(batches):
        import zlib

        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                names = [row[k] for k in key_names]
                found = row["cells"]
                n = np.array([c["n"] for c in found], dtype=np.int64)
                pos = np.array([c["n_pos"] for c in found], dtype=np.int64)
                weights = np.concatenate([pos, n - pos]).astype(float)
                rng = np.random.default_rng([seed, zlib.crc32(repr(names).encode())])
                drawn = rng.multinomial(int(n.sum()), weights / weights.sum(), size=replicates)
                hits, misses = drawn[:, : len(n)], drawn[:, len(n):]
                size = hits + misses
                rate = np.where(size > 0, hits / np.maximum(size, 1), np.nan)
                with np.errstate(all="ignore"):
                    low, high = np.nanpercentile(rate, [tail, 100 - tail], axis=0)
                for i, c in enumerate(found):
                    out.append([
                        *names, c["bin"], c["n"], c["n_pos"] / c["n"], c["p_sum"] / c["n"],
                        low[i], high[i],
                    ])
            yield pd.DataFrame(
                out,
                columns=[*key_names, "bin", "n", "prob_true", "prob_pred", "lower", "upper"],
            )

    return table.mapInPandas(draw, schema)


def calibration_comparison(
    original: DataFrame, oversampled: DataFrame, bins: int = 10,
    baselines: Sequence[str] = ("random_baseline", "majority_class"),
) -> DataFrame:
    """Curves of the models present in both modes, side by side per (model, bin)."""
    keep = ~F.col("model").isin(*baselines)
    sides = []
    for frame, name in ((original, "original"), (oversampled, "smote")):
        curve = calibration_curve(frame.where(keep), ["model"], bins)
        sides.append(
            curve.select(
                "model", "bin", F.col("prob_true").alias(f"{name}_true"),
                F.col("prob_pred").alias(f"{name}_pred"),
            )
        )
    shared = original.where(keep).select("model").intersect(oversampled.where(keep).select("model"))
    joined = sides[0].join(sides[1], ["model", "bin"], "full")
    return joined.join(F.broadcast(shared), "model", "left_semi")
