"""Every corpus query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from graphloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    with duckdb.connect() as c:
        for table in os.listdir(SF):
            c.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{table}')")
        want = c.sql(queries.ORACLES[name])
        columns = sorted(want.columns)
        rows = Counter(str([r[want.columns.index(x)] for x in columns]) for r in want.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert Counter(str([r[x] for x in columns]) for r in got.collect()) == rows
