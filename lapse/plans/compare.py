"""Original against oversampled runs: metric changes per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = {"auc": "roc_auc", "f1": "f1", "brier": "brier_score"}


def comparison_table(
    original: DataFrame, oversampled: DataFrame, keys: Sequence[str] = ("dataset", "model"),
    include_baselines: bool = True,
) -> DataFrame:
    """AUC, F1 and Brier of both modes and their change, one row per (dataset, model).

    A model missing in one mode keeps its row with null values and null changes. Baselines are
    recognised by the ``is_baseline`` flag when the metric tables carry it.
    """
    def side(frame: DataFrame, mode: str) -> DataFrame:
        if not include_baselines and "is_baseline" in frame.columns:
            frame = frame.where(~F.col("is_baseline"))
        return frame.select(
            *keys,
            *[F.when(~F.isnan(c), F.col(c)).alias(f"{mode}_{short}") for short, c in COMPARED.items()],
        )

    joined = side(original, "original").join(side(oversampled, "smote"), list(keys), "full")
    return joined.withColumns({
        f"{short}_change": F.col(f"smote_{short}") - F.col(f"original_{short}") for short in COMPARED
    })


def auc_trend(sensitivity: DataFrame) -> DataFrame:
    """Per dataset and model: AUC at the largest window minus AUC at the smallest one."""
    known = sensitivity.where(F.col("roc_auc").isNotNull())
    return known.groupBy("dataset", "model").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min_by("roc_auc", "window_days").alias("first_auc"),
        F.max_by("roc_auc", "window_days").alias("last_auc"),
    ).where(F.col("n_windows") > 1).withColumn("trend", F.col("last_auc") - F.col("first_auc"))
