import numpy as np
import pandas as pd
import pytest

from lapse.operators import relative as R


@pytest.fixture(scope="module")
def stream(spark):
    """A third of all events belong to one customer."""
    rng = np.random.default_rng(11)
    n = 3000
    who = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 25, n))
    at = pd.Timestamp("2020-01-01") + pd.to_timedelta(rng.permutation(n) * 977, unit="s")
    pdf = pd.DataFrame({
        "customer_id": who, "event_time": at, "product_id": rng.integers(0, 9, n).astype(str),
        "track_name": rng.integers(0, 400, n).astype(str)})
    pdf = pdf.sort_values("event_time")
    pdf["order_number"] = pdf.groupby("customer_id").cumcount() + 1
    pdf["days_since_prior_order"] = rng.integers(0, 30, n).astype(float)
    return pdf, spark.createDataFrame(pdf)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_customers_change_nothing(stream):
    _, df = stream
    small = dict(row_limit=200)
    assert rows(R.listening_table(df)) == rows(R.listening_table(df, **small))
    assert rows(R.cadence_labels(df)) == rows(R.cadence_labels(df, **small))
    assert rows(R.inter_event_days(df)) == rows(R.inter_event_days(df, **small))
    a = R.history_split(df, "customer_id", "order_number")
    b = R.history_split(df, "customer_id", "order_number", **small)
    assert rows(a.select("customer_id", "order_number", "observed")) == rows(
        b.select("customer_id", "order_number", "observed"))


def test_listening_against_pandas(stream):
    pdf, df = stream
    got = {r["customer_id"]: r for r in R.listening_table(df, row_limit=300).collect()}
    for who, mine in pdf.groupby("customer_id"):
        if len(mine) < 50:
            assert who not in got
            continue
        cut = max(1, int(len(mine) * 0.7))
        early, late = mine.iloc[:cut], mine.iloc[cut:]
        days = lambda f: max(1, (f.event_time.max() - f.event_time.min()).days + 1)
        row = got[who]
        assert row["total_listens"] == cut and row["unique_tracks"] == early.track_name.nunique()
        assert row["lapsed"] == int(len(late) / days(late) < 0.5 * cut / days(early))
        gap = early.event_time.diff().dt.total_seconds().max() / 86400
        assert row["max_gap_between_sessions"] == pytest.approx(gap)


def test_cadence_against_pandas(stream):
    pdf, df = stream
    got = {r["customer_id"]: r["lapsed"] for r in R.cadence_labels(df).collect()}
    for who, mine in pdf.groupby("customer_id"):
        gaps = mine.sort_values("order_number").days_since_prior_order.replace(0, np.nan)
        cut = max(1, int(len(mine) * 0.7))
        early, late = gaps.iloc[:cut].mean(), gaps.iloc[cut:].mean()
        if len(mine) < 3 or np.isnan(early) or np.isnan(late):
            assert who not in got
        else:
            assert got[who] == int(late > 1.5 * early)
