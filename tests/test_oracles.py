"""Every registered query with SQL gives the rows DuckDB gives; the others give rows."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    expected = duck.sql(ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    got = got[columns].sort_values(columns).reset_index(drop=True)
    expected = expected[columns].sort_values(columns).reset_index(drop=True)
    assert len(got) == len(expected)
    for column in columns:
        a, b = got[column], expected[column]
        same = (a == b) | (a.isna() & b.isna())
        if a.dtype.kind == "f":
            same |= np.isclose(a.astype(float), b.astype(float), atol=2e-6)
        assert same.all(), (column, a[~same].head(), b[~same].head())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_all_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"route", "n", "mean_p"}
