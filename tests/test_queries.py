"""Every query with SQL gives the rows that DuckDB gives for it, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from graphloom import catalogue

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Also compared on larger tables, where ties, rounding and limits are met.
ALSO = ("archive_scan", "figures_kept", "keyword_topk_all", "node_scan", "risk_distribution", "search_indexed", "shortest_paths_whole", "store_patched")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def databases():
    found = {}
    for sf in filter(os.path.isdir, (SF, LARGER)):
        found[sf] = duckdb.connect()
        for name in os.listdir(sf):
            found[sf].execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return found


@pytest.mark.parametrize(("sf", "name"), [*((SF, n) for n in sorted(catalogue.ORACLES)), *((LARGER, n) for n in ALSO)])
def test_query(spark, databases, sf, name):
    if sf not in databases:
        pytest.skip("no tables here")
    sql, got = databases[sf], catalogue.QUERIES[name](spark, sf)
    want = sql.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at, to = [want.columns.index(c) for c in columns], [got.columns.index(c) for c in columns]
    assert Counter(str([r[i] for i in to]) for r in got.collect()) == Counter(str([r[i] for i in at]) for r in want.fetchall())


def test_catalogue_is_complete():
    assert catalogue.FLAGSHIP in catalogue.QUERIES and set(catalogue.ORACLES) <= set(catalogue.QUERIES)
