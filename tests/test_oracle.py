"""Every query that has SQL gives the same rows as that SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from lipika.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(DATA):
        connection.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    cells = [[None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in frame[c].tolist()] for c in columns]
    return columns, sorted(zip(*cells), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_others_give_rows(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
