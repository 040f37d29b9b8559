"""Time cutoffs, inactivity and native labels, user-disjoint cohorts, validity checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.functions import scalars as S
from lapse.functions import timing as tm
from lapse.operators.order_stats import exact_quantiles
from lapse.schema import CUSTOMER, REQUIRED_COLUMNS, TIME, require_columns
from lapse.session import spread_shuffles

LABEL = "lapsed"


@dataclass(frozen=True)
class Cutoffs:
    """Driver-side instants; as literals they push down to every later scan."""

    train: datetime
    test: datetime
    window_days: float
    last_event: datetime

    def frame(self, spark) -> DataFrame:
        schema = "train_cutoff timestamp, test_cutoff timestamp, window_days double"
        return spark.createDataFrame([(self.train, self.test, float(self.window_days))], schema)


@dataclass(frozen=True)
class LabelPoint:
    """A named snapshot and the label window (snapshot, snapshot + window]."""

    name: str
    snapshot: datetime
    window_days: float

    @property
    def end(self) -> datetime:
        return tm.plus_days(self.snapshot, self.window_days)


def _timeline(events: DataFrame, q: float) -> tuple[datetime, datetime]:
    """Last event and exact time quantile; the first aggregate also counts for the second."""
    row = events.agg(F.max(tm.micros(TIME)).alias("m"), F.count(TIME).alias("n")).first()
    if row["m"] is None:
        raise ValueError("no events with a time")
    # Everything after the cutoffs is grouped by customer, over as many rows.
    spread_shuffles(events.sparkSession, row["n"])
    middle = exact_quantiles(events, tm.micros(TIME), [q], total=row["n"])[0]
    return tm.from_micros(row["m"]), tm.from_micros(tm.nearest_micros(middle))


def time_quantile(events: DataFrame, q: float) -> datetime:
    """Exact interpolated quantile of the event times, on microseconds."""
    return tm.from_micros(tm.nearest_micros(exact_quantiles(events, tm.micros(TIME), [q])[0]))


def global_cutoffs(events: DataFrame, window_days: float = 180, q: float = 0.7) -> Cutoffs:
    """Test cutoff one window before the end; train cutoff at the time quantile.

    A train cutoff that is not earlier than the test cutoff moves to one window before it.
    """
    last, train = _timeline(events, q)
    test = tm.plus_days(last, -window_days)
    if train >= test:
        train = tm.plus_days(test, -window_days)
    return Cutoffs(train, test, window_days, last)


def cutoffs_for_windows(events: DataFrame, windows: Sequence[float], q: float = 0.7) -> list[Cutoffs]:
    """Cutoffs of several windows from one pass over the times."""
    last, middle = _timeline(events, q)
    out = []
    for window in windows:
        test = tm.plus_days(last, -window)
        train = middle if middle < test else tm.plus_days(test, -window)
        out.append(Cutoffs(train, test, window, last))
    return out


def labels_at(events: DataFrame, points: Sequence[LabelPoint]) -> DataFrame:
    """Inactivity labels for several snapshots from a single aggregate per customer.

    Output: point, customer_id, lapsed; one row per point and customer with history before it. An
    event exactly at the snapshot counts for neither side; the window end is inclusive.
    """
    latest = max(p.end for p in points)
    scope = events.where(F.col(CUSTOMER).isNotNull() & (F.col(TIME) <= tm.instant(latest)))
    active = [
        F.max(
            F.when(
                (F.col(TIME) > tm.instant(p.snapshot)) & (F.col(TIME) <= tm.instant(p.end)), 1
            ).otherwise(0)
        ).alias(f"_active_{i}")
        for i, p in enumerate(points)
    ]
    per_customer = scope.groupBy(CUSTOMER).agg(F.min(TIME).alias("_first"), *active)
    options = F.array(
        *[
            F.when(
                F.col("_first") < tm.instant(p.snapshot),
                F.struct(
                    F.lit(p.name).alias("point"), (1 - F.col(f"_active_{i}")).alias(LABEL)
                ),
            )
            for i, p in enumerate(points)
        ]
    )
    return (
        per_customer.select(CUSTOMER, F.explode(F.array_compact(options)).alias("_o"))
        .select(F.col("_o.point").alias("point"), CUSTOMER, F.col(f"_o.{LABEL}").alias(LABEL))
    )


def inactivity_labels(events: DataFrame, snapshot: datetime, window_days: float = 180) -> DataFrame:
    """customer_id, lapsed: 1 when the customer has no event in (snapshot, snapshot + window]."""
    require_columns(events, REQUIRED_COLUMNS, "labels")
    return labels_at(events, [LabelPoint("snapshot", snapshot, window_days)]).drop("point")


def label_summary(labels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, lapse rate, imbalance ratio and the extreme-rate flag (below 1 % or above 99 %)."""
    y = F.col(LABEL)
    out = labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        S.count_where(y == 1).alias("n_pos"),
        S.count_where(y == 0).alias("n_neg"),
        F.avg(y.cast("double")).alias("lapse_rate"),
    )
    rate = F.col("lapse_rate")
    return out.withColumn("imbalance_ratio", S.imbalance("n_neg", "n_pos")).withColumn(
        "extreme_rate", (rate < 0.01) | (rate > 0.99)
    )


def require_labels(labels: DataFrame, snapshot: datetime) -> DataFrame:
    """Raise when no customer has history before the snapshot."""
    if labels.isEmpty():
        raise ValueError(f"no customers with events before cutoff {snapshot:%Y-%m-%d}")
    return labels


def native_labels(df: DataFrame, source: str = LABEL) -> DataFrame:
    """customer_id, lapsed from a label column the source ships; one row per customer."""
    require_columns(df, [CUSTOMER, source], "native labels")
    return df.groupBy(CUSTOMER).agg(F.min(F.col(source).cast("int")).alias(LABEL))


# ------------------------------------------------------------------------ user-disjoint cohorts


@dataclass(frozen=True)
class Cohorts:
    """Cutoffs of the user-disjoint split and the per-customer cohort table."""

    cutoffs: Cutoffs
    customers: DataFrame

    @property
    def points(self) -> list[LabelPoint]:
        c = self.cutoffs
        return [
            LabelPoint("train", c.train, c.window_days), LabelPoint("test", c.test, c.window_days)
        ]


def disjoint_cutoffs(events: DataFrame, window_days: float, q: float = 0.7) -> Cutoffs:
    """Train observation end C and test snapshot b, with C at least one window before b."""
    require_columns(events, REQUIRED_COLUMNS, "user-disjoint split")
    usable = events.where(F.col(CUSTOMER).isNotNull() & F.col(TIME).isNotNull())
    last, middle = _timeline(usable, q)
    test = tm.plus_days(last, -window_days)
    train = min(middle, tm.plus_days(test, -window_days))
    return Cutoffs(train, test, window_days, last)


def disjoint_cohorts(events: DataFrame, window_days: float, q: float = 0.7) -> Cohorts:
    """Assign every customer to train, test or excluded by first event, with labels and counts.

    Train customers arrive before C and are labelled on (C, C+W]; test customers arrive in [C, b)
    and are labelled on (b, b+W]. One aggregate per customer carries everything.
    """
    cut = disjoint_cutoffs(events, window_days, q)
    c, b = tm.instant(cut.train), tm.instant(cut.test)
    c_end = tm.instant(tm.plus_days(cut.train, window_days))
    b_end = tm.instant(tm.plus_days(cut.test, window_days))
    t = F.col(TIME)
    per_customer = (
        events.where(F.col(CUSTOMER).isNotNull() & t.isNotNull())
        .groupBy(CUSTOMER)
        .agg(
            F.min(t).alias("first_event"),
            S.count_where(t < c).alias("before_c"),
            S.count_where(t < b).alias("before_b"),
            S.count_where(t > c).alias("after_c"),
            S.count_where(t > b).alias("after_b"),
            S.count_where((t > c) & (t <= c_end)).alias("in_c"),
            S.count_where((t > b) & (t <= b_end)).alias("in_b"),
        )
    )
    first = F.col("first_event")
    train, test = first < c, (first >= c) & (first < b)
    pick = lambda a, z: F.when(train, F.col(a)).when(test, F.col(z))
    customers = per_customer.select(
        CUSTOMER,
        F.when(train, "train").when(test, "test").otherwise("excluded").alias("cohort"),
        first,
        pick("before_c", "before_b").alias("history_events"),
        pick("in_c", "in_b").alias("label_events"),
        pick("after_c", "after_b").alias("events_after"),
    ).withColumn(
        LABEL,
        F.when(F.col("cohort") != "excluded", F.when(F.col("label_events") > 0, 0).otherwise(1)),
    )
    return Cohorts(cut, customers)


def cohort_summary(cohorts: Cohorts) -> DataFrame:
    """One row: sizes, shares, event counts, cutoffs and lapse rates of the split.

    Label events are those inside the label window; ``*_events_after`` count everything later.
    """
    k = F.col("cohort")
    in_cohort = lambda name, c: F.coalesce(F.sum(F.when(k == name, F.col(c))), F.lit(0))
    out = cohorts.customers.agg(
        F.count(F.lit(1)).alias("n_raw"),
        S.count_where(k == "train").alias("n_train"),
        S.count_where(k == "test").alias("n_test"),
        S.count_where(k == "excluded").alias("n_excluded"),
        in_cohort("train", "history_events").alias("train_events"),
        in_cohort("test", "history_events").alias("test_events"),
        in_cohort("train", "label_events").alias("train_label_events"),
        in_cohort("test", "label_events").alias("test_label_events"),
        in_cohort("train", "events_after").alias("train_events_after"),
        in_cohort("test", "events_after").alias("test_events_after"),
        F.avg(F.when(k == "train", F.col(LABEL))).alias("lapse_train"),
        F.avg(F.when(k == "test", F.col(LABEL))).alias("lapse_test"),
    )
    return out.select(
        "*",
        S.ratio("n_train", "n_raw").alias("train_share"),
        S.ratio("n_test", "n_raw").alias("test_share"),
        S.ratio("n_excluded", "n_raw").alias("excluded_share"),
        tm.instant(cohorts.cutoffs.train).alias("train_cutoff"),
        tm.instant(cohorts.cutoffs.test).alias("test_snapshot"),
    )


def check_cohorts(
    sizes: DataFrame, min_train: int = 100, min_test: int = 50
) -> None:
    """Raise when matrix sizes or rates make the split unusable.

    ``sizes`` has one row with n_train, n_test, n_shared, lapse_train and lapse_test.
    """
    row = sizes.first()
    if row["n_shared"]:
        raise ValueError(f"{row['n_shared']} users appear in both train and test")
    if row["n_train"] < min_train:
        raise ValueError(f"train cohort too small ({row['n_train']} < {min_train})")
    if row["n_test"] < min_test:
        raise ValueError(f"test cohort too small ({row['n_test']} < {min_test})")
    for side in ("train", "test"):
        rate = row[f"lapse_{side}"]
        if rate is None or not 0.0 < rate < 1.0:
            raise ValueError(f"degenerate {side} lapse rate {rate}")


# ------------------------------------------------------------------------- validity assertions

# Names that a label goes by whatever the source; a source declares its own on top.
LABEL_NAMES = (LABEL, "label", "target", "target_event")


def label_like(columns: Sequence[str], declared: Sequence[str] = ()) -> list[str]:
    """Columns that may tell the outcome, whatever their case."""
    names = {n.lower() for n in (*LABEL_NAMES, *declared)}
    return sorted(c for c in columns if c.lower() in names)


def temporal_checks(
    events: DataFrame, cutoffs: Cutoffs, labels: DataFrame, feature_columns: Sequence[str],
    declared: Sequence[str] = (),
) -> DataFrame:
    """check, passed, detail for the global temporal split.

    ``labels`` holds both cohorts. Checks: both label windows observed, no target-like feature,
    train before test, labels binary.
    """
    spark = events.sparkSession
    leaked = label_like(feature_columns, declared)
    ends = {
        "train": tm.plus_days(cutoffs.train, cutoffs.window_days),
        "test": tm.plus_days(cutoffs.test, cutoffs.window_days),
    }
    rows = [
        (f"{side}_label_window_observed", cutoffs.last_event >= end,
         f"needs events up to {end:%Y-%m-%d}, last event {cutoffs.last_event:%Y-%m-%d}")
        for side, end in ends.items()
    ]
    rows.append(("no_target_columns", not leaked, f"leaked: {leaked or 'none'}"))
    rows.append((
        "cutoff_order", cutoffs.train < cutoffs.test,
        f"train cutoff {cutoffs.train:%Y-%m-%d}, test cutoff {cutoffs.test:%Y-%m-%d}",
    ))
    static = spark.createDataFrame(rows, "check string, passed boolean, detail string")
    odd = labels.agg(S.count_where(~F.col(LABEL).isin(0, 1) | F.col(LABEL).isNull()).alias("n"))
    binary = odd.select(
        F.lit("labels_binary").alias("check"),
        (F.coalesce(F.col("n"), F.lit(0)) == 0).alias("passed"),
        F.concat(F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" labels outside 0/1"))
        .alias("detail"),
    )
    return static.unionByName(binary)


def assert_checks(checks: DataFrame) -> list[str]:
    """Raise on the first failed check; otherwise the passed check names."""
    rows = checks.collect()
    failed = [r for r in rows if not r["passed"]]
    if failed:
        raise RuntimeError(f"{failed[0]['check']}: {failed[0]['detail']}")
    return [r["check"] for r in rows]
