"""Each query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from fourfold.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("null" if x != x or x is None else f"{float(x):.5f}" if isinstance(x, float) else str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    columns, got = rows(catalogue.queries()[name](spark, sf_dir).toPandas())
    want_columns, want = rows(con.execute(catalogue.oracle_sql()[name]).df())
    assert columns == want_columns
    assert got == want


def test_every_query_is_listed_once():
    assert len(catalogue.queries()) == sum(len(m.QUERIES) for m in catalogue.MODULES)
