"""Queries over every two consecutive lines against brute force; those with SQL are in test_queries.py too."""

import os
from collections import defaultdict

import duckdb
import pytest

from graphloom import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def lines(sf_dir):
    return duckdb.sql(f"SELECT a.l_partkey, b.l_partkey FROM '{sf_dir}/lineitem.parquet' a JOIN '{sf_dir}/lineitem.parquet' b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey").fetchall()


def reached(after, start):
    """Least steps to all that start reaches."""
    depth, front = {start: 0}, [start]
    while front:
        front = list({y for x in front for y in after[x]} - set(depth))
        depth |= dict.fromkeys(front, max(depth.values()) + 1)
    return depth


def following(pairs):
    after = defaultdict(set)
    for a, b in pairs:
        after[a].add(b)
    return after


def test_edges_are_all_lines(spark):
    got = catalogue.QUERIES["graph_edges_whole"](spark, SF)
    assert got.agg({"weight": "sum"}).first()[0] == len(lines(SF))
    assert catalogue.QUERIES["graph_edges"](spark, SF).count() < got.count() / 10  # and only inside


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Few orders, so that there are components of many sizes."""
    at = tmp_path_factory.mktemp("small")
    for t in ("part", "lineitem"):
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet' {'WHERE l_orderkey % 12 = 0' if t == 'lineitem' else ''}) TO '{at}/{t}.parquet'")
    return str(at)


@pytest.mark.parametrize("which", ["small", "all"])
def test_components_depths_and_counts(spark, small, which):
    sf_dir = small if which == "small" else SF
    after = following(lines(sf_dir))
    run = lambda name: catalogue.QUERIES[f"{name}_whole"](spark, sf_dir).collect()
    ids = [r.id for r in run("closure_counts")]
    down = {i: set(reached(after, i)) for i in ids}
    part = {i: min(j for j in down[i] if i in down[j]) for i in ids}
    assert {r.id: r.component for r in run("scc_components")} == part
    assert {r.id: r.dependencies for r in run("closure_counts")} == {i: len(down[i]) - 1 for i in ids}
    members = defaultdict(list)
    for i in ids:
        members[part[i]].append(i)
    assert {(r.component, r.members) for r in run("cycle_members")} == {(c, ",".join(map(str, sorted(m)))) for c, m in members.items() if len(m) > 1}
    known = {}

    def depth(c):
        if c not in known:
            known[c] = max((depth(d) + 1 for d in {part[y] for x in members[c] for y in after[x]} - {c}), default=0)
        return known[c]

    assert {r.id: r.depth for r in run("condensation_depth")} == {i: depth(part[i]) for i in ids}


@pytest.mark.parametrize("name", ["risk_scores", "risk_distribution", "hotspots_topk"])
def test_risks_equal_sql(spark, small, name):
    from graphloom.plans.whole_queries import whole_sql

    with duckdb.connect() as c:
        for t in ("part", "lineitem"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        want = c.sql(whole_sql(name))
        got = catalogue.QUERIES[f"{name}_whole"](spark, small).select(*want.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_shortest_paths_from_the_stated_set_to_all(spark):
    after = following(lines(SF))
    got = {(r.source, r.target): r.length for r in catalogue.QUERIES["shortest_path_len_whole"](spark, SF).collect()}
    want = {(a, b): d for a in sorted(after) if a % 100 == 0 for b, d in reached(after, a).items() if a != b}
    assert got == want and len({a for a, _ in got}) == 2


def test_scaled_impact_is_of_all_lines(spark, small):
    sql = catalogue.ORACLES["impact_summary_scaled"]
    assert "l_quantity" not in sql
    with duckdb.connect() as c:
        for t in ("part", "lineitem"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        want = c.sql(sql)
        got = catalogue.QUERIES["impact_summary_scaled"](spark, small).select(*want.columns).collect()
        assert list(map(str, map(tuple, got))) == list(map(str, want.fetchall())) and got[0].total > 0
