"""Every training-data query that has SQL gives the same rows as that SQL in DuckDB."""

import os

import duckdb
import pytest
from test_oracle import DATA, rows

from lipika.llm import queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SQL = sql.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(connection.sql(SQL[name]).df())
