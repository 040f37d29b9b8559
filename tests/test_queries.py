"""Every query with a SQL text must match it on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
import check_queries as C



@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, sf_dir, db, name):
    df = contract.queries()[name](spark, sf_dir)
    got = df.collect()
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    a, b = C._rows(got, df.columns), C._rows(want, columns)
    assert len(a) == len(b)
    assert all(C._same(x, y) for p, q in zip(a, b) for x, y in zip(p, q))


def test_entry_has_rows(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_text_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
