"""Labelled train and test matrices for each of the four split routes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators import labels as L
from lapse.operators.features import POINT, feature_columns, feature_matrix
from lapse.operators.splits import stratified_split
from lapse.schema import CUSTOMER
from lapse.session import materialise


@dataclass(frozen=True)
class ModelingData:
    """Train and test rows: customer_id, lapsed and the same feature columns in the same order."""

    train: DataFrame
    test: DataFrame
    route: str
    train_cutoff: object = None
    test_cutoff: object = None
    cutoffs: L.Cutoffs | None = None

    @property
    def features(self) -> list[str]:
        return feature_columns(self.train)


def _side(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col(POINT) == name).drop(POINT)


def join_labels(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner alignment of a matrix with its labels on (point and) customer."""
    keys = [c for c in (POINT, CUSTOMER) if c in matrix.columns]
    joined = matrix.join(labels.select(*keys, L.LABEL), keys, "inner")
    return joined.select(*keys, L.LABEL, *feature_columns(matrix))


def global_table(
    events: DataFrame, cutoffs: L.Cutoffs, groups: Sequence[str] | None = None
) -> DataFrame:
    """Both cohorts of the global split in one frame: point, customer_id, lapsed, features."""
    points = [
        L.LabelPoint("train", cutoffs.train, cutoffs.window_days),
        L.LabelPoint("test", cutoffs.test, cutoffs.window_days),
    ]
    matrix = feature_matrix(events, {p.name: p.snapshot for p in points}, groups)
    return join_labels(matrix, L.labels_at(events, points))


def global_split(
    events: DataFrame, window_days: float = 180, q: float = 0.7,
    groups: Sequence[str] | None = None,
) -> ModelingData:
    cutoffs = L.global_cutoffs(events, window_days, q)
    # Both sides read one table, so the feature build runs once.
    table = materialise(global_table(events, cutoffs, groups))
    return ModelingData(
        _side(table, "train"), _side(table, "test"), "global_temporal",
        cutoffs.train, cutoffs.test, cutoffs,
    )


def disjoint_table(
    events: DataFrame, cohorts: L.Cohorts, groups: Sequence[str] | None = None
) -> DataFrame:
    """Both user-disjoint cohorts, each at its own snapshot with its own label window.

    Everyone with history before C is a train customer, so only the test side needs the cohort join.
    """
    usable = events.where(F.col(CUSTOMER).isNotNull())
    matrix = feature_matrix(usable, {p.name: p.snapshot for p in cohorts.points}, groups)
    labels = cohorts.customers.where(F.col("cohort") != "excluded").select(
        F.col("cohort").alias(POINT), CUSTOMER, L.LABEL
    )
    return join_labels(matrix, labels)


def split_sizes(table: DataFrame) -> DataFrame:
    """One row for :func:`lapse.operators.labels.check_cohorts`."""
    point = F.col(POINT)
    per_customer = table.groupBy(CUSTOMER).agg(
        F.max(F.when(point == "train", F.col(L.LABEL))).alias("train"),
        F.max(F.when(point == "test", F.col(L.LABEL))).alias("test"),
    )
    return per_customer.agg(
        F.count("train").alias("n_train"),
        F.count("test").alias("n_test"),
        S.count_where(F.col("train").isNotNull() & F.col("test").isNotNull()).alias("n_shared"),
        F.avg("train").alias("lapse_train"),
        F.avg("test").alias("lapse_test"),
    )


def disjoint_split(
    events: DataFrame, window_days: float, q: float = 0.7, groups: Sequence[str] | None = None,
    min_train: int = 100, min_test: int = 50,
) -> ModelingData:
    """User-disjoint matrices; raises when a cohort is too small, shared or single-class."""
    cohorts = L.disjoint_cohorts(events, window_days, q)
    table = materialise(disjoint_table(events, cohorts, groups))
    L.check_cohorts(split_sizes(table), min_train, min_test)
    return ModelingData(
        _side(table, "train"), _side(table, "test"), "user_disjoint",
        cohorts.cutoffs.train, cohorts.cutoffs.test, cohorts.cutoffs,
    )


def native_split(
    predictors: DataFrame, labels: DataFrame, ratio: float = 0.7, seed: int = 42
) -> ModelingData:
    """Stratified split of native predictors joined with native labels."""
    table = materialise(join_labels(predictors, labels))
    train, test = stratified_split(table, L.LABEL, 1 - ratio, seed=seed, salt="native")
    return ModelingData(
        train, test, "native_stratified", "native_stratified_train", "native_stratified_test"
    )


def native_snapshot_split(
    events: DataFrame, labels: DataFrame, q: float = 0.7, groups: Sequence[str] | None = None
) -> ModelingData:
    """Fallback for native labels on a synthetic timeline: snapshots at the quantile and the end."""
    last = events.agg(F.max(tm.micros("event_time")).alias("m")).first()["m"]
    train_at: datetime = L.time_quantile(events, q)
    test_at = tm.from_micros(last)
    matrix = feature_matrix(events, {"train": train_at, "test": test_at}, groups)
    keyed = matrix.join(labels.select(CUSTOMER, L.LABEL), CUSTOMER, "inner")
    table = materialise(keyed.select(POINT, CUSTOMER, L.LABEL, *feature_columns(matrix)))
    return ModelingData(
        _side(table, "train"), _side(table, "test"), "native_snapshot", train_at, test_at
    )
