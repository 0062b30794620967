"""Graph operators on small graphs with answers worked out by hand."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, impact, metrics

ENTITY = "id long, name string, qualified_name string, kind string, parent_id long, stereotype string, package_name string, module string, complexity int, is_abstract boolean, file_id long"
EDGE = "src long, dst long, type string, weight long"


def entities(spark, rows):
    return spark.createDataFrame([(i, f"n{i}", f"q.N{i}", k, p, s, "p", "m", 1, False, i) for i, k, p, s in rows], ENTITY)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, 1) for a, b, t in rows], EDGE)


@pytest.fixture(scope="module")
def dispatch(spark):
    nodes = [(1, "CLASS", None, None), (3, "CLASS", None, "CONTROLLER"), (5, "INTERFACE", None, None), (7, "CLASS", None, None), (2, "METHOD", 1, None), (4, "METHOD", 3, None), (6, "METHOD", 5, None), (8, "METHOD", 7, None), (9, "ENDPOINT", 3, None)]
    links = [(2, 6, "CALLS"), (8, 6, "OVERRIDES"), (4, 2, "CALLS"), (4, 6, "CALLS"), (9, 4, "ROUTES_TO"), (7, 5, "IMPLEMENTS")]
    return entities(spark, nodes), edges(spark, links)


def depths(df):
    return {r.node: r.depth for r in df.collect()}


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "id long")


@pytest.mark.parametrize("most", [graph.MAX_EDGES, 0])
def test_dispatch(spark, dispatch, most):
    _, edge = dispatch
    assert depths(graph.bfs(spark, edge, ids(spark, 8), graph.UPSTREAM, 30, True, max_edges=most)) == {8: 0, 6: 0, 2: 1, 4: 1, 9: 2}
    assert depths(graph.bfs(spark, edge, ids(spark, 8), graph.UPSTREAM, 30, False, max_edges=most)) == {8: 0}
    assert depths(graph.bfs(spark, edge, ids(spark, 9), graph.DOWNSTREAM, 30, max_edges=most)) == {9: 0, 4: 1, 2: 2, 6: 2}
    assert depths(graph.bfs(spark, edge, ids(spark, 9), graph.DOWNSTREAM, 1, max_edges=most)) == {9: 0, 4: 1}


@pytest.mark.parametrize("most", [graph.MAX_EDGES, 0])
def test_overriders_beside_the_start_are_left_out(spark, most):
    edge = edges(spark, [(2, 1, "OVERRIDES"), (3, 1, "OVERRIDES"), (4, 1, "CALLS")])
    assert set(depths(graph.bfs(spark, edge, ids(spark, 2), graph.UPSTREAM, 30, True, max_edges=most))) == {2, 1, 4}


def test_paths(spark, dispatch):
    entity, edge = dispatch
    path = graph.shortest_path(spark, edge, 9, 6).orderBy("position").collect()
    assert [r.node for r in path] == [9, 4, 6] and graph.shortest_path(spark, edge, 6, 9).count() == 0
    found = graph.all_paths(spark, edge, ids(spark, 9), ids(spark, 6), 6, 20)
    assert sorted(r.path for r in found.collect()) == [[9, 4, 2, 6], [9, 4, 6]]
    assert graph.all_paths(spark, edge, ids(spark, 9), ids(spark, 6), 6, 1).count() == 1 == graph.all_paths(spark, edge, ids(spark, 9), ids(spark, 6), 2, 20).count()
    assert {r.direction for r in graph.path_query(spark, entity, edge, 6, 9).collect()} == {"UPSTREAM"}
    assert {tuple(r.path) for r in graph.path_query(spark, entity, edge, 3, 5).collect()} == {(3, 5), (3, 1, 5)}


@pytest.mark.parametrize("near", [graph.NEAR_TARGETS, 0])
@pytest.mark.parametrize("most", [1, 3, 100])
def test_paths_of_random_graphs(spark, near, most):
    import random

    r = random.Random(8)
    links = {(r.randrange(14), r.randrange(14)) for _ in range(40)}
    links = {(a, b) for a, b in links if a != b}
    after = {a: sorted(b for x, b in links if x == a) for a in range(14)}

    def walk(path, target):
        if path[-1] == target and len(path) > 1:
            yield path
        elif len(path) <= 5:
            for b in after[path[-1]]:
                if b not in path:
                    yield from walk([*path, b], target)

    sources, targets = (0, 1, 2, 3), (3, 4, 5, 6)
    want = sorted(p for s in sources for t in targets if s != t for p in sorted(walk([s], t), key=lambda p: (len(p), p))[:most])
    found = graph.all_paths(spark, edges(spark, [(a, b, "CALLS") for a, b in links]), ids(spark, *sources), ids(spark, *targets), 5, most, near)
    assert sorted(list(x.path) for x in found.collect()) == want


def test_roll_up(spark, dispatch):
    got = {(r.src, r.dst, r.type) for r in graph.roll_up(*dispatch).collect()}
    assert got == {(1, 5, "CALLS"), (3, 1, "CALLS"), (3, 5, "CALLS"), (7, 5, "OVERRIDES"), (7, 5, "IMPLEMENTS")}


def test_nested_types_do_not_depend_on_each_other(spark):
    entity = entities(spark, [(1, "CLASS", None, None), (2, "CLASS", 1, None), (3, "FIELD", 1, None)])
    assert graph.roll_up(entity, edges(spark, [(2, 1, "CALLS"), (3, 2, "USES_TYPE")])).count() == 0


@pytest.mark.parametrize("most", [graph.MAX_EDGES, 0])
def test_components_and_depth(spark, most):
    entity = entities(spark, [(i, "METHOD", None, None) for i in range(1, 9)])
    edge = edges(spark, [(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 1, "CALLS"), (4, 1, "CALLS"), (3, 5, "CALLS"), (6, 7, "CALLS"), (7, 6, "CALLS"), (4, 6, "CALLS")])
    part = graph.components(spark, entity, edge, most)
    assert {r.id: r.component for r in part.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    deep = graph.depths(spark, entity, edge, part, most)
    assert {r.id: r.depth for r in deep.collect()} == {5: 0, 1: 1, 2: 1, 3: 1, 4: 2, 6: 0, 7: 0, 8: 0}


def test_cycles(spark):
    entity = entities(spark, [(i, "CLASS", None, None) for i in (1, 2, 3)])
    assert [r.members for r in graph.cycles(spark, entity, edges(spark, [(1, 2, "CALLS"), (2, 1, "CALLS"), (3, 1, "CALLS")])).collect()] == [[1, 2]]
    assert graph.cycles(spark, entity, edges(spark, [(1, 2, "CALLS")])).count() == 0


def test_build_drops_loops_and_loose_ends(spark, dispatch):
    entity, edge = dispatch
    more = edge.unionByName(edges(spark, [(1, 1, "CALLS"), (1, 99, "CALLS"), (2, 6, "CALLS")]))
    got = graph.build(entity, more)
    assert got.count() == 6 and got.where("src = 2 and dst = 6").first().weight == 2


def test_metrics_stay_in_bounds(spark, dispatch):
    entity, edge = dispatch
    found = metrics.measured(spark, entity, edge)
    top = metrics.scale(found)
    rows = {r.id: r for r in metrics.scored(found, top).collect()}
    assert all(0 <= r.risk <= 100 and r.level in ("LOW", "MEDIUM", "HIGH") for r in rows.values())
    assert rows[6].dependents == 4 and rows[8].dependents == 4 and rows[4].exposed and rows[3].exposed
    points = metrics.contributions(metrics.scored(found, top)).groupBy("id").sum("points").collect()
    assert all(abs(r[1] - rows[r.id].risk) < 0.11 for r in points)


def test_coupling(spark, dispatch):
    entity, edge = dispatch
    one = metrics.coupling(entity, edge, "package_name").collect()
    assert len(one) == 1 and (one[0].types, one[0].ca, one[0].ce, one[0].instability) == (4, 0, 0, 0.0)


def test_impact(spark, dispatch):
    entity, edge = dispatch
    seeds = impact.seeds_of_entity(entity, ids(spark, 8))
    rows = {r.id: r.depth for r in impact.affected(spark, entity, edge, seeds).collect()}
    assert rows == {2: 1, 4: 1, 9: 2}  # not 6, which only stands in for 8
    top = metrics.scale(metrics.measured(spark, entity, edge))
    s = impact.summary(spark, entity, edge, seeds, top, ids(spark, 8)).first()
    assert (s.direct, s.total, s.max_depth, s.endpoints, s.exposed, s.truncated) == (2, 3, 2, 1, True, False)
    assert {r.id for r in impact.seeds_of_entity(entity, ids(spark, 3)).collect()} == {3, 4, 9}


def test_view(spark, dispatch):
    entity, edge = dispatch
    risk = entity.selectExpr("id", "cast(id as double) risk")
    view = graph.neighbourhood(spark, entity, edge, risk, ids(spark, 4), 1, 3)
    assert [(r.id, r.distance) for r in view.collect()] == [(4, 0), (9, 1), (6, 1)] and all(r.truncated for r in view.collect())
    assert graph.induced(edge, view).count() == 2
    assert [r.id for r in graph.neighbourhood(spark, entity, edge, risk, None, 1, 2).collect()] == [9, 8]


def test_closure_both_ways_of_running(spark):
    import random

    r = random.Random(4)
    entity = entities(spark, [(i, "ENDPOINT" if i % 7 == 0 else "METHOD", None, None) for i in range(60)])
    edge = edges(spark, sorted({(r.randrange(55), r.randrange(55), r.choice(["CALLS", "OVERRIDES", "USES_TYPE"])) for _ in range(80)}))
    edge = edge.where("src <> dst")
    small, large = (sorted(map(tuple, graph.closure(spark, entity, edge, max_edges=most).collect())) for most in (graph.MAX_EDGES, 0))
    assert small == large and len(small) == 60


def test_facts_and_digest(spark, dispatch):
    import json

    from graphloom.operators import questions

    entity, edge = dispatch
    found = metrics.measured(spark, entity, edge)
    scored = metrics.scored(found, metrics.scale(found))
    said = {r.id: json.loads(r.facts) for r in questions.facts(entity, scored.drop("kind"), edge).collect()}
    assert said[9]["depends_on"] == "n4" and said[6]["metrics"]["fan_in"] == 3 and said[3]["role"] == "CONTROLLER"
    seeds = ids(spark, 8)
    s = impact.summary(spark, entity, edge, seeds, metrics.scale(found), seeds)
    one = json.loads(questions.digest(s, impact.by_role(impact.affected(spark, entity, edge, seeds), seeds)).first().facts)
    assert one["total"] == 3 and one["roles"]["CONTROLLER"] == 1


def test_explanations(spark, dispatch):
    """A change of an override gets to callers of what it overrides, by a step that costs nothing."""
    entity, edge = dispatch
    rows = impact.explanations(spark, entity, edge, ids(spark, 8)).collect()
    got = {r.id: (r.depth, [(x.node, x.type, x.dispatch) for x in r.path]) for r in rows}
    seed = [(8, None, False), (6, "OVERRIDES", True)]
    assert got == {2: (1, [*seed, (2, "CALLS", False)]), 4: (1, [*seed, (4, "CALLS", False)]), 9: (2, [*seed, (4, "CALLS", False), (9, "ROUTES_TO", False)])}
    tree = graph.hops(spark, edge, ids(spark, 9), graph.DOWNSTREAM)
    assert {r.node: (r.depth, r.via, r.type) for r in tree.collect()} == {9: (0, None, None), 4: (1, 9, "ROUTES_TO"), 2: (2, 4, "CALLS"), 6: (2, 4, "CALLS")}
    assert [r.path[-1].node for r in graph.explained(spark, tree, ids(spark, 6, 77)).collect()] == [6]


def test_overrides_in_a_circle_end(spark):
    edge = edges(spark, [(1, 2, "OVERRIDES"), (2, 1, "OVERRIDES"), (3, 1, "CALLS"), (4, 2, "CALLS")])
    tree = graph.hops(spark, edge, ids(spark, 1), graph.UPSTREAM, 30, True)
    assert {(r.node, r.flag): r.depth for r in tree.collect()} == {(1, False): 0, (2, True): 0, (1, True): 0, (3, False): 1, (2, False): 1, (4, False): 1}


def test_deep_nesting(spark):
    entity = entities(spark, [(1, "CLASS", None, None), *((i, "METHOD", i - 1, None) for i in range(2, 12)), (20, "FIELD", None, None)])
    assert {r.id: r.owner_id for r in graph.owners(entity).collect()} == {**{i: 1 for i in range(1, 12)}, 20: None}
    assert {r.id for r in impact.seeds_of_entity(entity, ids(spark, 3)).collect()} == set(range(3, 12))
    nested = entities(spark, [(i, "CLASS", i - 1 if i > 1 else None, None) for i in range(1, 9)])
    assert graph.enclosing(nested).count() == 28


def random_links(spark, nodes, links, seed):
    import random

    r = random.Random(seed)
    rows = sorted({(r.randrange(nodes), r.randrange(nodes), r.choice(["CALLS", "OVERRIDES", "USES_TYPE"])) for _ in range(links)})
    return edges(spark, [x for x in rows if x[0] != x[1]])


def test_rounds_equal_blocks(spark):
    """What starts reach apart and together, as bits in rounds and in blocks."""
    edge = random_links(spark, 140, 300, 1)
    starts = ids(spark, *range(0, 140))
    for step, limit in ((graph.moves(edge), 5), (graph.moves(edge, graph.UPSTREAM, True), 3)):
        small, large = ({tuple(x) for x in graph.reach(spark, step, starts, limit, max_edges=most).collect()} for most in (graph.MAX_EDGES, 0))
        assert small == large and len(small) > 140
        few = starts.where("id % 50 = 3")
        small, large = ({tuple(x)[1:] for x in graph.reach(spark, step, few, limit, max_edges=most, together=True).collect()} for most in (graph.MAX_EDGES, 0))
        assert small == large


@pytest.mark.parametrize("links", [70, 200])
def test_closures_of_sparse_and_dense_graphs(spark, links):
    entity = entities(spark, [(i, "ENDPOINT" if i % 7 == 0 else "METHOD", None, None) for i in range(130)])
    edge = random_links(spark, 120, links, links)
    small, large = (sorted(map(tuple, graph.closure(spark, entity, edge, max_edges=most).collect())) for most in (graph.MAX_EDGES, 0))
    assert small == large and len(small) == 130


def test_starts_together_are_no_rows_apart(spark, monkeypatch):
    """A traversal from all starts together beyond the bound has a row for each state, not for each start and state."""
    rows, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda spark, df: (out := write(spark, df), rows.append(out.count()))[0])
    edge = edges(spark, [(i, i + 1, "CALLS") for i in range(6)] + [(6, 0, "CALLS")])
    assert graph.bfs(spark, edge, ids(spark, *range(7)), max_edges=0).count() == 7 and max(rows) <= 7


def test_rows_of_bits_are_for_components(spark, monkeypatch):
    """A closure beyond the bound keeps no bits of nodes that reach each other."""
    bits = []
    monkeypatch.setattr(graph, "_gained", lambda spark, moved, seen, state, own=graph._gained: (bits.append(sum(x.count() for x in seen)), own(spark, moved, seen, state))[1])
    entity = entities(spark, [(i, "METHOD", None, None) for i in range(70)])
    edge = edges(spark, [(i, (i + k) % 70, "CALLS") for i in range(70) for k in (1, 5, 25)])
    assert {(r.dependents, r.dependencies, r.component) for r in graph.closure(spark, entity, edge, max_edges=0).collect()} == {(69, 69, 0)}
    assert max(bits) == 1


def test_pieces_that_fit_need_no_rounds(spark, monkeypatch):
    """Of a graph beyond the bound only pieces that are beyond it themselves are followed round by round."""
    import random

    r, rows = random.Random(5), set()
    for lo, nodes, links in ((0, 30, 60), (100, 8, 12), (200, 6, 6), (300, 12, 20)):
        rows |= {(lo + r.randrange(nodes), lo + r.randrange(nodes), r.choice(["CALLS", "OVERRIDES"])) for _ in range(links)}
    edge = edges(spark, sorted(x for x in rows if x[0] != x[1]))
    entity = entities(spark, [(i, "ENDPOINT" if i % 7 == 0 else "METHOD", None, None) for i in [*range(35), *range(100, 110), *range(200, 208), *range(300, 312)]])
    slow, large, joined = [], graph._large_closure, graph._joined
    monkeypatch.setattr(graph, "_large_closure", lambda spark, nodes, *more: (slow.extend(x.id for x in nodes.collect()), large(spark, nodes, *more))[1])
    want, got = (sorted(map(tuple, graph.closure(spark, entity, edge, max_edges=most).collect())) for most in (graph.MAX_EDGES, 25))
    assert want == got and len(got) == 65 and slow and max(slow) < 100
    monkeypatch.setattr(graph, "_joined", lambda spark, nodes, links: (slow.extend(x.id for x in nodes.collect()), joined(spark, nodes, links))[1])
    part = graph.components(spark, entity, edge, 25)
    assert sorted(map(tuple, part.collect())) == sorted((x[0], x[4]) for x in want) and max(slow) < 100
    want, got = (sorted(map(tuple, graph.depths(spark, entity, edge, part, most).collect())) for most in (graph.MAX_EDGES, 5))
    assert want == got


@pytest.mark.parametrize("links", [10, 30, 60])
def test_strong_components(links):
    import numpy as np

    rng = np.random.default_rng(links)
    for _ in range(50):
        src, dst = rng.integers(0, 25, links), rng.integers(0, 25, links)
        on = np.eye(25, dtype=bool)
        on[src, dst] = True
        for k in range(25):
            on |= on[:, [k]] & on[[k]]
        part = graph.strong(25, src, dst)
        assert ((part[:, None] == part) == (on & on.T)).all()


def test_traversals_in_pieces_that_fit_need_no_rounds(spark, monkeypatch):
    """What starts reach apart in small pieces, by bits in tasks; a piece that is too large still goes by rounds."""
    part = lambda at, seed: random_links(spark, 20, 28, seed).withColumns({"src": F.col("src") + at, "dst": F.col("dst") + at})
    edge = part(0, 1).unionByName(part(100, 2)).unionByName(part(200, 3).unionByName(random_links(spark, 30, 90, 4).withColumns({"src": F.col("src") + 300, "dst": F.col("dst") + 300})))
    starts, rounds, apart = ids(spark, *range(0, 340)), [], graph._reach_apart
    monkeypatch.setattr(graph, "_reach_apart", lambda spark, step, starts, limit: (rounds.append({r.id // 100 for r in starts.collect()}), apart(spark, step, starts, limit))[1])
    for step, limit, most in ((graph.moves(edge), 4, 50), (graph.moves(edge, graph.UPSTREAM, True), 3, 75)):
        want, got = ({tuple(x) for x in graph.reach(spark, step, starts, limit, max_edges=n).collect()} for n in (graph.MAX_EDGES, most))
        assert want == got and len(got) > 340
    assert rounds == [{3}, {3}]


def test_paths_do_not_ask_for_targets_as_far_as_the_bound(spark, dispatch, monkeypatch):
    """Nodes that are only as near as the longest path allows are most of all: they are no rows."""
    limits, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda spark, step, starts, limit, **more: (limits.append(limit), reach(spark, step, starts, limit, **more))[1])
    edge = edges(spark, [(1, 2, "CALLS"), (2, 3, "CALLS"), (3, 4, "CALLS"), (1, 3, "CALLS")])
    found = {(r.target, tuple(r.path)) for r in graph.all_paths(spark, edge, ids(spark, 1, 4), ids(spark, 1, 4), 3).collect()}
    assert found == {(4, (1, 3, 4)), (4, (1, 2, 3, 4))} and limits == [2]


def test_owners_pass_no_entities_through_the_driver(spark):
    plan = graph.owners(entities(spark, [(1, "CLASS", None, None), (2, "METHOD", 1, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_task_closes_its_pieces_one_by_one(monkeypatch):
    """Chains that share a task: no start has bits beside the nodes of other chains, long ones alone and short ones some together."""
    chains, n = [*[40] * 3, *[3] * 20], 0
    rows, want = [], {}
    for size in chains:
        rows += [(n + i, n + i + 1) for i in range(size - 1)]
        want |= {n + i: (i, size - 1 - i, i > 0 and n % 2 == 0, n + i) for i in range(size)}
        n += size
    src, dst = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
    no = pa.array([False] * len(rows))
    firsts = [sum(chains[:i]) for i in range(len(chains))]
    links = pa.table({"src": src, "dst": dst, "over": no, "only": no, "end": pa.array([a % 2 == 0 and a in firsts for a, _ in rows])})
    states, make = [], graph.BitGraph
    monkeypatch.setattr(graph, "BitGraph", lambda many, *links: (states.append(many), make(many, *links))[1])
    got = graph._closure_of(pa.table({"id": pa.array([*range(n), 10**6], pa.int64())}), links, chunk=30)
    assert {r["id"]: (r["dependents"], r["dependencies"], r["reaches_endpoint"], r["component"]) for r in got.to_pylist()} == want | {10**6: (0, 0, False, 10**6)}
    assert max(states) <= 80  # two states a node; 360 with all chains at once


def test_sparse_connected_graphs_are_closed_by_lists(monkeypatch):
    """What starts reach in a large sparse piece are lists, whatever the pieces: bits would be nodes times starts. Long lists give way to bits."""
    import numpy as np

    rng = np.random.default_rng(7)
    src, dst = np.divmod(np.unique(rng.integers(0, 3000 * 3000, 2600)), 3000)
    chain = np.arange(2999)[rng.random(2999) < 0.5]
    src, dst = np.concatenate([src, chain]), np.concatenate([dst, chain + 1])
    src, dst = src[src != dst], dst[src != dst]
    over = rng.random(len(src)) < 0.2
    links = pa.table({"src": src, "dst": dst, "over": over, "only": over, "end": src % 7 == 0})
    starts = pa.table({"id": np.arange(0, 3000, 10)})
    bits, make = [], graph.BitGraph
    monkeypatch.setattr(graph, "BitGraph", lambda many, *links: (bits.append(many), make(many, *links))[1])
    got = {}
    for name, listed, lists in (("bits", 10**9, 1), ("few", 0, 3000), ("lists", 0, graph.LISTS)):
        bits.clear()
        monkeypatch.setattr(graph, "LISTED", listed)
        monkeypatch.setattr(graph, "LISTS", lists)
        got[name] = graph._closure_of(starts, links, chunk=64), len(bits)
    assert got["lists"][1] == 0 and got["bits"][1] and got["few"][1]
    assert got["lists"][0].equals(got["bits"][0]) and got["lists"][0].equals(got["few"][0])
    assert max(got["lists"][0]["dependents"].to_pylist()) > 100


def test_longest_ways_and_depths():
    import numpy as np

    src, dst = np.array([0, 0, 1, 2, 4, 5, 5]), np.array([1, 2, 2, 3, 5, 4, 6])
    assert graph.longest(8, src, dst).tolist() == [0, 1, 2, 3, -1, -1, -1, 0]
    ids, links = pa.table({"id": [10, 13, 11]}), pa.table({"a": [10, 10, 11, 12], "b": [11, 12, 12, 13]})
    assert graph._depths_of(ids, links)["depth"].to_pylist() == [3, 0, 2]
