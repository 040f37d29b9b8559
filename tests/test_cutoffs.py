import duckdb
import pytest
from pyspark.sql import functions as F

from lapse.functions import timing as tm
from lapse.operators import labels as L
from lapse.operators import rank_search as R

BASE = 1_705_000_000_000_000


def _sql(times, q):
    return duckdb.execute(
        f"SELECT quantile_cont(t, {q}), round(quantile_cont(t, {q}))::BIGINT FROM (SELECT unnest(?::BIGINT[]) AS t)", [times]).fetchall()[0]


@pytest.mark.parametrize("gap", [5, 15, 30_039_248, 86_400_000_000])
@pytest.mark.parametrize("n", [4, 5, 555, 6_000])
def test_time_quantile_is_that_of_sql(n, gap):
    times = sorted(BASE + 7 * i + gap * (i + i % 3) for i in range(n))
    place = 0.7 * (n - 1)
    raw = R.interpolated(times[int(place)], times[min(int(place) + 1, n - 1)], place - int(place))
    assert (raw, tm.nearest_micros(raw)) == _sql(times, 0.7)


def test_half_a_microsecond_goes_up_in_cutoffs(spark):
    # The median lies 2.5 microseconds after an even instant: SQL takes 3.
    times = [BASE - 9, BASE, BASE + 5, BASE + 10**12]
    events = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "customer_id int, t long").select(
        "customer_id", F.timestamp_micros("t").alias("event_time"))
    for q in (0.5, 0.7, 0.75):
        assert tm.to_micros(L.time_quantile(events, q)) == _sql(times, q)[1]
        assert tm.to_micros(L.global_cutoffs(events, 1, q).train) == _sql(times, q)[1]


def test_halves_go_away_from_zero():
    assert [tm.nearest_micros(v) for v in (2.5, 3.5, -2.5, 2.4, -0.4, 0.0)] == [3, 4, -3, 2, 0, 0]
