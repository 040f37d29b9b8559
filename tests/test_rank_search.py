import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapse.operators import order_stats as O
from lapse.operators import profile as P
from lapse.operators import rank_search as R
from lapse.operators import splits as SP


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({
        "a": np.where(rng.random(n) < 0.4, 4.0, rng.exponential(10, n)), "b": rng.normal(size=n), "c": np.full(n, 7.0),
        "d": np.where(rng.random(n) < 0.9, np.nan, rng.random(n)), "g": rng.integers(0, 3, n)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


@pytest.mark.parametrize("direct", [10**6, 3_000, 40])
def test_all_columns_at_once(wide, direct):
    pdf, df = wide
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.7, 0.999, 1.0]
    got = R.column_quantiles(df, ["a", "b", "c", "d", F.lit(None).cast("double")], probabilities, direct)
    for c, values in zip("abcd", got):
        assert np.allclose(values, np.quantile(pdf[c].dropna(), probabilities), rtol=1e-12), c
    assert got[4] == [None] * len(probabilities)


@pytest.mark.parametrize("direct", [10**6, 30])
def test_ranks_of_groups(wide, direct):
    pdf, df = wide
    values = df.select(F.col("g").cast("int").alias("series"), F.col("a").alias("v"))
    ranks = [0, 1, 700, 2_500, 5_000]
    found = R.find_ranks(values, lambda counts: {s: [*ranks, n - 1] for s, n in counts.items()}, direct=direct)
    for s, some in found.items():
        want = np.sort(pdf.a[pdf.g == s].to_numpy())
        assert all(some[r] == want[r] for r in some) and len(some) == 6


def test_whole_numbers_stay_exact(spark):
    big = 2**60
    df = spark.range(5_000).select((F.lit(big) + F.col("id")).alias("v"))
    assert O.order_statistic(df, "v", 4_321, direct_rows=20) == big + 4_321
    assert R.column_quantiles(df, ["v", F.col("v") + 1], [1.0], 20) == [[float(big + 4_999)], [float(big + 5_000)]]


def _jobs(spark, build):
    """Jobs that ``build`` runs before its result is asked for."""
    tracker, group = spark.sparkContext.statusTracker(), f"count-{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, group)
    build()
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    return len(jobs)


def test_few_jobs_before_the_result(spark, wide):
    _, df = wide
    df = df.withColumn("customer_id", F.monotonically_increasing_id()).cache()
    df.count()
    labelled = df.withColumn("lapsed", (F.col("g") > 0).cast("int"))
    assert _jobs(spark, lambda: P.quality_report(df, outlier_columns=["a", "b", "c", "d"])) <= 4
    assert _jobs(spark, lambda: SP.with_folds(labelled, 5)) <= 4
    assert _jobs(spark, lambda: SP.stratified_split(labelled)) <= 4
