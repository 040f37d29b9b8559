from pyspark.sql import functions as F

from lapse import session as S
from lapse.operators import labels as L

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_shuffles_after_the_cutoffs_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SHUFFLE_ROWS", 100)
    events = spark.range(5_000).select(
        (F.col("id") % 900).alias("customer_id"), F.timestamp_micros(F.col("id") * 10**10).alias("event_time"), F.lit("purchase").alias("event_type"))
    try:
        cohorts = L.disjoint_cohorts(events, 30)
        plan = cohorts.customers._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(customer_id" in plan and ", 50)" in plan
        assert S.spread_shuffles(spark, 10) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for key in (INITIAL, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)
