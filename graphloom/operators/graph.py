"""Dependency graphs: building, degrees, roll-up, traversal with override dispatch, paths, components and depth.

Depth is the least over all routes and dispatch steps cost nothing, so results do not depend on the order of visits.
Traversals from many starts run in parallel over blocks of starts, each of which meets a copy of the edges by a shuffle,
while these number at most MAX_EDGES; beyond that the frontier is joined with the edges round by round, 64 starts in a row
as bits. Joins of tables that grow with the graph are by shuffle: no edge passes through the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.schema import TYPE_KINDS
from graphloom.tables import written

#: So many edges fit a task beside a block of starts.
MAX_EDGES = 400_000
#: And so many where they are arrays of numbers only.
MAX_LINKS = 1_000_000
#: Starts that a block has at least.
BLOCK = 256
#: Small pieces of a graph are put together until they have about so many edges.
PACK = 50_000
UPSTREAM, DOWNSTREAM = "UPSTREAM", "DOWNSTREAM"


def merge_edges(edge: DataFrame) -> DataFrame:
    """One row for each (src, dst, type); weights add up."""
    return edge.groupBy("src", "dst", "type").agg(F.sum("weight").cast("long").alias("weight"))


def build(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges without loops and without ends that are no entities."""
    ids = entity.select("id")
    kept = edge.where("src <> dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return merge_edges(kept)


def degree(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """id, fan_in, fan_out: distinct neighbours, 0 for entities without any."""
    pairs = edge.select("src", "dst").distinct()
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    into = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return entity.select("id").join(into, "id", "left").join(out, "id", "left").select("id", zero("fan_in"), zero("fan_out"))


def owners(entity: DataFrame) -> DataFrame:
    """id, owner_id: the nearest enclosing type (a type is its own), null without one. Members of members are followed up
    as deep as they are nested."""
    is_type = F.col("kind").isin(*TYPE_KINDS)
    at = entity.select("id", F.when(is_type, F.col("id")).alias("owner_id"), F.when(~is_type, F.col("parent_id")).alias("up"))
    parent = entity.select(F.col("id").alias("up"), F.when(is_type, F.col("id")).alias("found"), F.when(~is_type, F.col("parent_id")).alias("next"))
    climb = lambda rows: rows.join(parent.hint("merge"), "up", "left").select("id", F.coalesce("owner_id", "found").alias("owner_id"), F.col("next").alias("up"))
    at, done = climb(at), None
    if parent.where("next is not null").select(F.col("next").alias("up")).join(parent.where("next is not null"), "up", "left_semi").isEmpty():
        return at.select("id", "owner_id")
    while True:  # some member is a member's
        at = written(entity.sparkSession, at)
        ready = at.where("owner_id is not null or up is null").select("id", "owner_id")
        done = ready if done is None else done.unionByName(ready)
        at = at.where("owner_id is null and up is not null")
        if at.isEmpty():
            return done
        at = climb(at)


def enclosing(entity: DataFrame) -> DataFrame:
    """id, outer: every pair of a type and a type that it is nested in, however deep."""
    up = entity.where(F.col("kind").isin(*TYPE_KINDS)).select("id", F.col("parent_id").alias("outer")).where("outer is not null")
    found, step = up, up
    while not step.isEmpty():
        step = written(entity.sparkSession, step.join(up.select(F.col("id").alias("outer"), F.col("outer").alias("next")), "outer").select("id", F.col("next").alias("outer")))
        found = found.unionByName(step)
    return found


def roll_up(entity: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges lifted to owner types, without those inside a type or between a type and one that it is nested in."""
    own, nested = owners(entity).where("owner_id is not null"), enclosing(entity)
    lifted = edge.join(own.select(F.col("id").alias("src"), F.col("owner_id").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("owner_id").alias("b")), "dst")
    lifted = lifted.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst"), "type").agg(F.sum("weight").cast("long").alias("weight"))
    both = nested.select(F.col("id").alias("src"), F.col("outer").alias("dst")).unionByName(nested.select(F.col("outer").alias("src"), F.col("id").alias("dst")))
    return lifted.join(both.distinct(), ["src", "dst"], "left_anti")


def moves(edge: DataFrame, direction: str = DOWNSTREAM, dispatch: bool = False) -> DataFrame:
    """Steps of a traversal: frm, to, cost, flag (of the state reached), closed (not from flagged states).

    Upstream with dispatch, what a node overrides joins it at no cost, flagged; from a flagged node overriders are not
    followed.
    """
    if direction == DOWNSTREAM:
        return edge.select(F.col("src").alias("frm"), F.col("dst").alias("to"), F.lit(1).alias("cost"), F.lit(False).alias("flag"), F.lit(False).alias("closed")).distinct()
    over = F.col("type") == "OVERRIDES"
    back = edge.select(F.col("dst").alias("frm"), F.col("src").alias("to"), F.lit(1).alias("cost"), F.lit(False).alias("flag"), (over & F.lit(dispatch)).alias("closed"))
    if dispatch:
        back = back.unionByName(edge.where(over).select(F.col("src").alias("frm"), F.col("dst").alias("to"), F.lit(0).alias("cost"), F.lit(True).alias("flag"), F.lit(False).alias("closed")))
    return back.groupBy("frm", "to", "cost", "flag").agg(F.min("closed").alias("closed"))


def dealt(spark: SparkSession) -> int:
    """Partitions for few rows that cost much each: a count that isn't reduced for their small size."""
    return 2 * spark.sparkContext.defaultParallelism


def by_blocks(spark: SparkSession, starts: DataFrame, edge: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run over blocks of starts (id), each with all edges: these are shuffled once for each block, never broadcast or collected.
    Blocks are no more than tasks run at once, twice over; the caller has checked how many edges there are."""
    many = max(1, min(dealt(spark), starts.count() // BLOCK))
    left = starts.select("id", F.pmod(F.xxhash64("id"), F.lit(many)).alias("block")).repartition(many, "block")
    right = edge.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("block")).repartition(many, "block")

    def of(key: tuple, ids: pa.Table, edges: pa.Table) -> pa.Table:
        return run(ids, edges)

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(of, schema)


def pieces(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id, piece (the least id that links lead to, whichever way) of every end of links (src, dst).

    Each node hangs on its least neighbour if that is less; trees become stars by doubling, a star becomes one node, and the
    links between stars go on: at least half of the nodes go in each round.
    """
    left = written(spark, links.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b"))
    stars: list[DataFrame] = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        tree = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to")))
        while True:
            up = tree.select(F.col("id").alias("to"), F.col("to").alias("up")).hint("merge")
            tree = written(spark, tree.join(up, "to").select("id", F.col("up").alias("to"), (F.col("up") != F.col("to")).alias("moved")))
            if tree.where("moved").isEmpty():
                break
        tree = tree.select("id", "to")
        stars.append(tree)
        at = lambda name, to: tree.select(F.col("id").alias(name), F.col("to").alias(to)).hint("merge")  # noqa: B023, E731
        left = left.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y")
        left = written(spark, left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not stars:
        return left.select(F.col("a").alias("id"), F.col("b").alias("piece"))
    out = stars.pop().withColumnRenamed("to", "piece")
    for star in reversed(stars):
        out = star.join(out.select(F.col("id").alias("to"), "piece").hint("merge"), "to", "left").select("id", F.coalesce("piece", "to").alias("piece"))
    return written(spark, out)


def packed(spark: SparkSession, links: DataFrame, max_edges: int) -> DataFrame:
    """id, pack: pieces of at most max_edges links each, small ones put together; null for the ends of larger pieces."""
    of = pieces(spark, links)
    size = links.join(of.select(F.col("id").alias("src"), "piece").hint("merge"), "src").groupBy("piece").agg(F.count("*").alias("n"))
    size = written(spark, size)
    least = max(1, min(PACK, max_edges) // 4)
    small = size.where(F.col("n") < least).agg(F.sum("n")).first()[0] or 0
    bins = F.lit(1 + small // (4 * least))
    own = F.when(F.col("n") <= max_edges, F.when(F.col("n") >= least, F.concat(F.lit("piece "), "piece")).otherwise(F.concat(F.lit("bin "), F.pmod(F.xxhash64("piece"), bins))))
    return written(spark, of.join(size.select("piece", own.alias("pack")).hint("merge"), "piece").select("id", "pack"))


def by_packs(spark: SparkSession, node: DataFrame, edge: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, split: bool) -> DataFrame:
    """run over the nodes (id, pack) of each pack with its edges (with their pack); split: few packs in blocks of nodes, each
    of which meets a copy of its pack's edges."""
    packs = node.select("pack").distinct().count()
    many = -(-dealt(spark) // max(packs, 1)) if split else 1
    tasks = max(1, min(4096, packs * many))
    left = node.select(F.col("id").alias("id"), F.col("pack").alias("pack"), F.pmod(F.xxhash64("id"), F.lit(many)).alias("block")).repartition(tasks, "pack", "block")
    right = edge.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("block")).repartition(tasks, "pack", "block")

    def of(key: tuple, ids: pa.Table, edges: pa.Table) -> pa.Table:
        return run(ids, edges)

    return left.groupBy("pack", "block").cogroup(right.groupBy("pack", "block")).applyInArrow(of, schema)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Ranges of so many numbers from each first one, side by side."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; NumPy's own takes hashes first, which costs more here."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def longest(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Links of the longest way that leads to each of n nodes, -1 for those in or after a cycle."""
    to = dst[np.argsort(src, kind="stable")]
    first = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(src, minlength=n), out=first[1:])
    left, out = np.bincount(dst, minlength=n).astype(np.int32), np.full(n, -1, np.int32)
    front, step = np.flatnonzero(left == 0), 0
    while len(front):
        out[front], step = step, step + 1
        hit, times = np.unique(to[spans(first[front], first[front + 1] - first[front])], return_counts=True)
        left[hit] -= times
        front = hit[left[hit] == 0]
    return out


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected component. Nodes that no cycle leads to, or that lead to none, are alone."""
    on = longest(n, src, dst) < 0
    links = on[src] & on[dst]
    src, dst = src[links], dst[links]
    on &= longest(n, dst, src) < 0
    links, core = on[src] & on[dst], np.flatnonzero(on)
    part, place = np.arange(n), np.cumsum(on) - 1
    if len(core):
        part[core] = n + _tarjan(len(core), place[src[links]], place[dst[links]])
    number = np.zeros(2 * n, np.int32)
    number[part] = 1
    return (np.cumsum(number, dtype=np.int32) - 1)[part]


def _tarjan(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The number of each node's strongly connected component, by Tarjan's search without recursion."""
    order = np.argsort(src, kind="stable")
    first, to = np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()
    low, place, part = [0] * n, first[:n], [-1] * n
    seen = parts = 0
    for root in range(n):
        if low[root]:
            continue
        seen += 1
        low[root] = seen
        path, stack, number = [root], [root], {root: seen}
        while path:
            v = path[-1]
            at, end, mine = place[v], first[v + 1], low[v]
            down = -1
            while at < end:
                w = to[at]
                at += 1
                if not low[w]:
                    down = w
                    break
                if part[w] < 0 and low[w] < mine:
                    mine = low[w]
            place[v], low[v] = at, mine
            if down >= 0:
                seen += 1
                low[down] = number[down] = seen
                path.append(down)
                stack.append(down)
                continue
            path.pop()
            if mine == number[v]:
                while True:
                    w = stack.pop()
                    part[w] = parts
                    if w == v:
                        break
                parts += 1
            if path and part[v] < 0 and mine < low[path[-1]]:
                low[path[-1]] = mine
    return np.array(part, np.int64)


class Adjacency:
    """Steps by their start, as sorted arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("frm")
        self.nodes, first = np.unique(rows["frm"].to_numpy(), return_index=True)
        self.first = np.append(first, len(rows))
        self.steps = list(zip(*(rows[c].to_pylist() for c in ("to", "cost", "flag", "closed")), strict=True))
        self.at = {n: i for i, n in enumerate(self.nodes.tolist())}

    def of(self, node: int) -> list[tuple[int, int, bool, bool]]:
        i = self.at.get(node)
        return [] if i is None else self.steps[self.first[i] : self.first[i + 1]]

    def reach(self, starts: list[int], limit: int) -> dict[int, list]:
        """Least depth of each node from any of the starts, and whether all routes there end on a flag: a search with steps of
        cost 0 and 1 over states (node, flag)."""
        depth = {(s, False): 0 for s in starts}
        queue = deque(depth)
        while queue:
            state = queue.popleft()
            node, flag = state
            d = depth[state]
            for to, cost, new, closed in self.of(node):
                if (flag and closed) or d + cost > limit:
                    continue
                if d + cost < depth.get((to, new), limit + 1):
                    depth[to, new] = d + cost
                    (queue.append if cost else queue.appendleft)((to, new))
        found: dict[int, list] = {}
        for (node, flag), d in depth.items():
            have = found.setdefault(node, [d, True])
            have[0], have[1] = min(have[0], d), have[1] and flag
        return found


def reach(spark: SparkSession, step: DataFrame, starts: DataFrame, limit: int = 1 << 20, max_edges: int = MAX_EDGES, together: bool = False) -> DataFrame:
    """start, node, depth, dispatched (no route without ending on a flag) of all that each start reaches, itself included;
    together: of all that any start of a block reaches, start being one of them."""
    starts = written(spark, starts.select(F.col("id").cast("long").alias("id")).distinct())
    step = written(spark, step)
    if step.count() <= max_edges:

        def run(ids: pa.Table, steps: pa.Table) -> pa.Table:
            graph, out = Adjacency(steps), ([], [], [], [])
            ids = sorted(ids["id"].to_pylist())
            for start in [ids] if together and ids else [[i] for i in ids]:
                for node, (d, flag) in graph.reach(start, limit).items():
                    for column, x in zip(out, (start[0], node, d, flag), strict=True):
                        column.append(x)
            return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["start", "node", "depth", "dispatched"])

        return by_blocks(spark, starts, step, run, "start long, node long, depth int, dispatched boolean")
    if together:
        return _reach_together(spark, step, starts, limit)
    node = packed(spark, step.select(F.col("frm").alias("src"), F.col("to").alias("dst")).where("src <> dst").distinct(), max_edges)
    starts = written(spark, starts.join(node.hint("merge"), "id", "left"))
    fit = starts.where("pack is not null")
    found = _reach_packs(spark, step.join(node.where("pack is not null").withColumnRenamed("id", "frm").hint("merge"), "frm"), fit, limit)
    # a start without steps is alone
    alone = starts.join(node.select("id").hint("merge"), "id", "left_anti")
    found = found.unionByName(alone.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(False).alias("dispatched")))
    rest = starts.where("pack is null").join(node.select("id").hint("merge"), "id", "left_semi").select("id")
    if not rest.isEmpty():
        large = node.where("pack is null").select(F.col("id").alias("frm")).hint("merge")
        found = found.unionByName(_reach_apart(spark, written(spark, step.join(large, "frm", "left_semi")), rest, limit))
    return found


#: Starts that a task follows at once.
STARTS = 1024
LEVELS = "pack string, block long, node long, word long, depth int, dispatched boolean"


def _levels_of(starts: pa.Table, steps: pa.Table, limit: int) -> pa.Table:
    """LEVELS: which starts (n; 64 to a block, as bits) reach a node first at each depth, over steps that fit a task. A state
    is 2 * node, or 1 more with the flag; all steps of a cost are followed at once."""
    ids, n = starts["id"].to_numpy(), starts["n"].to_numpy()
    frm, to, cost, flag, closed = (steps[c].to_numpy(zero_copy_only=False) for c in ("frm", "to", "cost", "flag", "closed"))
    nodes = np.unique(np.concatenate([ids, frm, to]))
    a, b = 2 * np.searchsorted(nodes, frm), 2 * np.searchsorted(nodes, to) + flag
    src, dst, cost = np.concatenate([a, a[~closed] + 1]), np.concatenate([b, b[~closed]]), np.concatenate([cost, cost[~closed]])
    by_cost = {}
    for c in (0, 1):
        order = np.flatnonzero(cost == c)
        order = order[np.argsort(dst[order], kind="stable")]
        by_cost[c] = src[order], dst[order]

    def onward(front: np.ndarray, seen: np.ndarray, cost: int) -> np.ndarray:
        """The bits that states gain from the front; seen has them from now on."""
        frm, to = by_cost[cost]
        live = front.any(axis=1)[frm]
        frm, to, gained = frm[live], to[live], np.zeros_like(front)
        if len(frm):
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = to[first]
            gained[ends] = np.bitwise_or.reduceat(front[frm], first, axis=0) & ~seen[ends]
            seen |= gained
        return gained

    out: list[tuple[np.ndarray, ...]] = []
    order = np.argsort(n)
    ids, n = ids[order], n[order]
    blocks, slot = np.unique(n // 64, return_inverse=True)
    wide = max(1, min(STARTS // 64, (1 << 23) // max(1, 2 * len(nodes))))  # tables of bits stay near 64 MB
    for lo in range(0, len(blocks), wide):
        mine = (slot >= lo) & (slot < lo + wide)
        front = np.zeros((2 * len(nodes), len(blocks[lo : lo + wide])), np.uint64)
        np.bitwise_or.at(front, (2 * np.searchsorted(nodes, ids[mine]), slot[mine] - lo), np.uint64(1) << (n[mine] % 64).astype(np.uint64))
        seen, held, levels = front.copy(), np.zeros((len(nodes), front.shape[1]), np.uint64), []
        for depth in range(limit + 1):
            level = fresh = front
            while len(by_cost[0][0]) and (fresh := onward(fresh, seen, 0)).any():
                level = level | fresh
            new = (level[0::2] | level[1::2]) & ~held
            held |= new
            at = np.nonzero(new)
            levels.append((*at, new[at], np.full(len(at[0]), depth)))
            if depth == limit or not (front := onward(level, seen, 1)).any():
                break
        row, col, word, depth = (np.concatenate(x) for x in zip(*levels, strict=True))
        plain = seen[0::2][row, col]
        for some, dispatched in ((word & plain, False), (word & ~plain, True)):
            on = some != 0
            out.append((blocks[lo + col[on]], nodes[row[on]], some[on].view(np.int64), depth[on], np.full(on.sum(), dispatched)))
    block, node, word, depth, dispatched = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
    pack = pa.repeat(starts["pack"][0], len(block)) if len(block) else pa.array([], pa.string())
    return pa.table([pack, pa.array(block, pa.int64()), pa.array(node, pa.int64()), pa.array(word, pa.int64()), pa.array(depth, pa.int32()), pa.array(dispatched.astype(bool))], names=["pack", "block", "node", "word", "depth", "dispatched"])


def _reach_packs(spark: SparkSession, step: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """As `reach`, of starts (id, pack) in pieces that fit a task. Tasks give bits, 64 starts in a row; only the result has a
    row for each start and node."""
    starts = written(spark, starts.withColumn("n", F.row_number().over(Window.partitionBy("pack").orderBy("id")).cast("long") - 1))
    many = -(-(starts.agg(F.max("n")).first()[0] or 0) // STARTS) or 1
    packs = starts.select("pack").distinct().count()
    many = max(many, -(-dealt(spark) // max(packs, 1)))
    tasks = max(1, min(4096, packs * many))
    part = F.pmod(F.shiftright("n", 6), F.lit(many))
    left = starts.withColumn("part", part).repartition(tasks, "pack", "part")
    right = step.join(starts.select("pack").distinct().hint("merge"), "pack", "left_semi")
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("part")).repartition(tasks, "pack", "part")

    def of(key: tuple, ids: pa.Table, steps: pa.Table) -> pa.Table:
        return _levels_of(ids, steps, limit) if len(ids) else pa.table({c.split()[0]: pa.array([], t) for c, t in zip(LEVELS.split(", "), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)})

    found = left.groupBy("pack", "part").cogroup(right.groupBy("pack", "part")).applyInArrow(of, LEVELS)
    ids = starts.groupBy("pack", F.shiftright("n", 6).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "id")))["id"].alias("ids"))
    rows = found.join(ids.hint("merge"), ["pack", "block"])
    return rows.select(F.explode(F.filter("ids", lambda x, i: F.getbit(F.col("word"), i) == 1)).alias("start"), "node", "depth", "dispatched")


def _reach_together(spark: SparkSession, step: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Least depths from any of the starts, by rounds over states: no table has a row for each start."""
    step = step.withColumnRenamed("frm", "node").withColumnRenamed("flag", "to_flag")
    seen = front = written(spark, starts.select(F.col("id").alias("node"), F.lit(False).alias("flag"), F.lit(0).alias("depth")))
    while not front.isEmpty():
        moved = step.join(front.hint("merge"), "node").where(~(F.col("flag") & F.col("closed")))
        moved = moved.select(F.col("to").alias("node"), F.col("to_flag").alias("flag"), (F.col("depth") + F.col("cost")).alias("depth")).where(F.col("depth") <= limit)
        old = seen.select(*STATE, F.lit(None).cast("int").alias("depth"), F.col("depth").alias("old"))
        both = moved.withColumn("old", F.lit(None).cast("int")).unionByName(old).groupBy(*STATE).agg(F.min("depth").alias("depth"), F.min("old").alias("old"))
        front = written(spark, both.where("depth < coalesce(old, depth + 1)").select(*STATE, "depth"))
        seen = written(spark, seen.unionByName(front).groupBy(*STATE).agg(F.min("depth").alias("depth")))
    first = F.broadcast(starts.agg(F.min("id").alias("start")))  # one row
    return seen.groupBy("node").agg(F.min("depth").alias("depth"), F.min("flag").alias("dispatched")).join(first, how="cross").select("start", "node", "depth", "dispatched")


def _reach_apart(spark: SparkSession, step: DataFrame, starts: DataFrame, limit: int) -> DataFrame:
    """Least depths from each start. Starts are bits: a row of a round stands for those of 64 starts that have just reached a
    state. Only the result has a row for each start and node."""
    starts = _numbered(spark, starts)
    flat = step.where("cost <> 1 or flag").isEmpty()
    step = step.withColumnRenamed("frm", "node").withColumnRenamed("flag", "to_flag")
    state = [*STATE, "block"]

    def onward(front: DataFrame, by: DataFrame, seen: list[DataFrame]) -> DataFrame:
        moved = by.join(front.hint("merge"), "node").where(~(F.col("flag") & F.col("closed")))
        return _gained(spark, moved.select(F.col("to").alias("node"), F.col("to_flag").alias("flag"), "block", "word"), seen, state)

    front = written(spark, starts.select(F.col("id").alias("node"), F.lit(False).alias("flag"), "block", _own()))
    seen, found = [front], [front.withColumn("depth", F.lit(0))]
    for depth in range(limit + 1):
        fresh, level = front, [front]
        while not flat and not (fresh := onward(fresh, step.where("cost = 0"), seen)).isEmpty():
            level.append(fresh)
            seen.append(fresh)
            found.append(fresh.withColumn("depth", F.lit(depth)))
        if depth == limit:
            break
        front = onward(_all(level), step.where("cost = 1"), seen)
        if front.isEmpty():
            break
        seen.append(front)
        found.append(front.withColumn("depth", F.lit(depth + 1)))
    ids = starts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bit", "id")))["id"].alias("ids"))
    rows = _all(found).join(ids.hint("merge"), "block").select(F.explode(F.filter("ids", lambda x, i: F.getbit(F.col("word"), i) == 1)).alias("start"), *STATE, "depth")
    if flat:  # each state is a node, found once
        return rows.select("start", "node", "depth", F.lit(False).alias("dispatched"))
    return rows.groupBy("start", "node").agg(F.min("depth").alias("depth"), F.min("flag").alias("dispatched"))


def _own() -> Column:
    """A start's own bit."""
    return F.expr("shiftleft(1L, CAST(bit AS INT))").alias("word")


def _numbered(spark: SparkSession, ids: DataFrame) -> DataFrame:
    """id, block, bit: 64 ids to a block."""
    number = F.monotonically_increasing_id()
    return written(spark, ids.select("id", F.shiftright(number, 6).alias("block"), number.bitwiseAND(63).alias("bit")))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _gained(spark: SparkSession, moved: DataFrame, seen: list[DataFrame], state: list[str]) -> DataFrame:
    """The bits (word) of moved that seen hasn't by state. What has been seen is a list of tables; nine become one."""
    if len(seen) > 8:
        seen[:] = [written(spark, _all(seen).groupBy(*state).agg(F.bit_or("word").alias("word")))]
    none = F.lit(0).cast("long")
    both = moved.select(*state, "word", none.alias("old")).unionByName(_all(seen).select(*state, none.alias("word"), F.col("word").alias("old")))
    both = both.groupBy(*state).agg(F.bit_or("word").alias("word"), F.bit_or("old").alias("old"))
    return written(spark, both.select(*state, F.col("word").bitwiseAND(F.bitwise_not("old")).alias("word")).where("word <> 0"))


def bfs(spark: SparkSession, edge: DataFrame, seeds: DataFrame, direction: str = DOWNSTREAM, limit: int = 30, dispatch: bool = False, **options) -> DataFrame:
    """node, depth, dispatched over all seeds together."""
    return reach(spark, moves(edge, direction, dispatch), seeds, limit, together=True, **options).groupBy("node").agg(F.min("depth").cast("int").alias("depth"), F.min("dispatched").alias("dispatched"))


STATE = ["node", "flag"]


def hops(spark: SparkSession, edge: DataFrame, seeds: DataFrame, direction: str = UPSTREAM, limit: int = 30, dispatch: bool = False) -> DataFrame:
    """A tree of the traversal: node, flag (reached by dispatch), depth, via and via_flag (where from), type (of the edge).

    Frontiers are joined with the edges round by round, dispatch steps of a depth first. A state is found in the first round
    that reaches it, from the least node, by the least type; seeds have no via. A node may be there with and without flag.
    """
    frm, to = ("dst", "src") if direction == UPSTREAM else ("src", "dst")
    over = F.col("type") == "OVERRIDES"
    steps = written(spark, edge.select(F.col(frm).alias("node"), F.col(to).alias("to"), "type", (over & F.lit(dispatch and direction == UPSTREAM)).alias("closed")).distinct())
    lifts = edge.where(over).select(F.col("src").alias("node"), F.col("dst").alias("to"), "type").distinct() if dispatch and direction == UPSTREAM else None

    def onward(front: DataFrame, by: DataFrame, flag: bool, depth: int, seen: DataFrame) -> DataFrame:
        moved = front.select(*STATE).join(by, "node")
        moved = moved.where(~(F.col("flag") & F.col("closed"))) if "closed" in by.columns else moved
        found = moved.groupBy(F.col("to").alias("node")).agg(F.min(F.struct("node", "flag", "type")).alias("x"))
        found = found.select("node", F.lit(flag).alias("flag"), F.lit(depth).alias("depth"), F.col("x.node").alias("via"), F.col("x.flag").alias("via_flag"), "x.type")
        return written(spark, found.join(seen.select(*STATE), STATE, "left_anti"))

    start = seeds.select(F.col("id").cast("long").alias("node"), F.lit(False).alias("flag"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("boolean").alias("via_flag"), F.lit(None).cast("string").alias("type"))
    seen = front = written(spark, start.dropDuplicates(["node"]))
    for depth in range(limit + 1):
        level, fresh = front, front
        while lifts is not None and not fresh.isEmpty():
            fresh = onward(fresh, lifts, True, depth, seen)
            seen, level = seen.unionByName(fresh), level.unionByName(fresh)
        if depth == limit:
            break
        front = onward(level, steps, False, depth + 1, seen)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return written(spark, seen)


def explained(spark: SparkSession, tree: DataFrame, asked: DataFrame) -> DataFrame:
    """id, path: from a seed to each node asked for (id), as steps (node, type of the edge to it, dispatch); of the tree that
    `hops` gives, by the node's state without flag where it has both."""
    ends = tree.join(asked.select(F.col("id").alias("node")).distinct(), "node", "left_semi").groupBy("node").agg(F.min("flag").alias("flag"))
    links = tree.select("node", "flag", "via", "via_flag", "type")
    at, done = ends.select(F.col("node").alias("id"), "node", "flag", F.array().cast("array<struct<node:bigint,type:string,dispatch:boolean>>").alias("path")), None
    while True:
        here = F.struct(F.col("node").cast("long").alias("node"), "type", F.col("flag").alias("dispatch"))
        at = written(spark, at.join(links, STATE).select("id", F.col("via").alias("node"), F.col("via_flag").alias("flag"), F.concat(F.array(here), "path").alias("path")))
        ready = at.where("node is null").select("id", "path")
        done = ready if done is None else done.unionByName(ready)
        at = at.where("node is not null")
        if at.isEmpty():
            return done


def shortest_path(spark: SparkSession, edge: DataFrame, source: int, target: int, limit: int = 30) -> DataFrame:
    """node, position of a shortest path (the least nodes first where several are as short); no rows without one."""
    pair = spark.createDataFrame([(source,)], "id long")
    down = reach(spark, moves(edge), pair, limit).select("node", F.col("depth").alias("near"))
    up = reach(spark, moves(edge, UPSTREAM), spark.createDataFrame([(target,)], "id long"), limit).select("node", F.col("depth").alias("far"))
    both = written(spark, down.join(up, "node").withColumn("all", F.col("near") + F.col("far")))
    on = both.where(F.col("all") == both.agg(F.min("all")).first()[0]) if not both.isEmpty() else both
    # walk back from the target, one node a level: the least predecessor that lies on a shortest path
    links = edge.select("src", "dst").distinct()
    path = on.where(F.col("node") == target).select("node", F.col("near").alias("position"))
    length = path.first()
    at = path
    for _ in range(length["position"] if length else 0):
        at = at.select(F.col("node").alias("dst"), (F.col("position") - 1).alias("position")).join(links, "dst").join(on.select(F.col("node").alias("src"), F.col("near").alias("position")), ["src", "position"])
        at = written(spark, at.groupBy("position").agg(F.min("src").alias("node")).select("node", "position"))
        path = path.unionByName(at)
    return path


#: Up to so many targets paths grow only where they can still arrive.
NEAR_TARGETS = 10_000


def all_paths(spark: SparkSession, edge: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 6, max_paths: int = 20, near: int = NEAR_TARGETS) -> DataFrame:
    """source, target, path (nodes): simple paths of at most max_depth edges, the shortest and least max_paths of each pair.

    With few targets (at most `near`) each path knows the one it is for: it grows only to nodes from which the target is near
    enough, and a pair that has max_paths paths of one length needs no longer ones. With more, paths grow everywhere.
    """
    links = edge.select(F.col("src").alias("at"), "dst").distinct()
    ends = targets.select(F.col("id").alias("target")).distinct()
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.size("path"), "path"))
    start = sources.select(F.col("id").alias("source")).distinct()
    found = None
    if ends.limit(near + 1).count() <= near:
        # what a first step leads to is a step nearer than its source: most nodes are only just near enough
        far = written(spark, reach(spark, moves(edge, UPSTREAM), ends.select(F.col("target").alias("id")), max_depth - 1).select(F.col("start").alias("target"), F.col("node").alias("dst"), F.col("depth").alias("far")))
        far, links = far.hint("merge"), written(spark, links).hint("merge")
        front = start.select("source", F.array("source").alias("path"), F.col("source").alias("at"))
        for depth in range(1, max_depth + 1):
            on = front.join(links, "at").where(~F.array_contains("path", F.col("dst")))
            front = on.join(far, "dst").where("source <> target") if depth == 1 else on.join(far, ["target", "dst"])
            front = front.where(F.col("far") + depth <= max_depth)
            front = written(spark, front.select("source", "target", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
            hit = front.where("at = target").select("source", "target", "path").withColumn("n", place).where(F.col("n") <= max_paths).drop("n")
            found = written(spark, hit if found is None else found.unionByName(hit))
            done = found.groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= max_paths)
            front = front.where("at <> target").join(done, ["source", "target"], "left_anti")
            if front.isEmpty():
                break
        return found.withColumn("n", place).where(F.col("n") <= max_paths).drop("n")
    front = start.select("source", F.array("source").alias("path"), F.col("source").alias("at"))
    for _ in range(max_depth):
        front = front.join(links, "at").where(~F.array_contains("path", F.col("dst")))
        front = written(spark, front.select("source", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        hit = front.join(ends, F.col("at") == F.col("target"), "left_semi").select("source", F.col("at").alias("target"), "path")
        found = hit if found is None else found.unionByName(hit)
        if front.isEmpty():
            break
    return found.withColumn("n", place).where(F.col("n") <= max_paths).drop("n")


def path_query(spark: SparkSession, entity: DataFrame, edge: DataFrame, a: int, b: int, max_depth: int = 6, max_paths: int = 20) -> DataFrame:
    """Paths from a to b, or else from b to a, on the type graph where both are types; with a column direction."""
    max_depth, max_paths = min(max(max_depth, 1), 30), min(max(max_paths, 1), 20)
    types = entity.where(F.col("id").isin(a, b) & F.col("kind").isin(*TYPE_KINDS)).count() == 2
    graph = roll_up(entity, edge) if types else edge
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    down = all_paths(spark, graph, one(a), one(b), max_depth, max_paths).withColumn("direction", F.lit(DOWNSTREAM))
    if not down.isEmpty():
        return down
    return all_paths(spark, graph, one(b), one(a), max_depth, max_paths).withColumn("direction", F.lit(UPSTREAM))


class BitGraph:
    """Which of up to 64 * k starts reach each state, as bits; all edges are followed at once until nothing changes."""

    def __init__(self, states: int, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(dst, kind="stable")
        self.states, self.src, self.dst = states, src[order], dst[order]

    def reach(self, seeds: np.ndarray) -> np.ndarray:
        """Rows by state, 64 starts in each column."""
        bits = np.zeros((self.states, (len(seeds) + 63) // 64), np.uint64)
        j = np.arange(len(seeds))
        np.bitwise_or.at(bits, (seeds, j // 64), np.uint64(1) << (j % 64).astype(np.uint64))
        changed = np.zeros(self.states, bool)
        changed[seeds] = True
        while True:
            live = changed[self.src]  # only steps from states that have gained starts
            src, dst = self.src[live], self.dst[live]
            if not len(src):
                break
            first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
            ends = dst[first]
            old = bits[ends]
            new = old | np.bitwise_or.reduceat(bits[src], first, axis=0)
            bits[ends] = new
            changed[:] = False
            changed[ends[(new != old).any(axis=1)]] = True
        return bits


class Layers:
    """Links without cycles, those to a node after those to all that lead to it."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        level = longest(n, src, dst)[dst]
        order = np.argsort(level * np.int64(n) + dst)
        self.n, self.src, self.dst, level = n, src[order], dst[order], level[order]
        self.bounds = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]])) if len(src) else np.zeros(1, int)

    def reached(self, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
        """node, start (its place): all that distinct starts reach, themselves included, in order; None if these are more than most."""
        k = len(starts)
        first, count = np.zeros(self.n, np.int32), np.zeros(self.n, np.int32)
        first[starts], count[starts] = np.arange(k), 1
        held, size = np.empty(most + k, np.int32), k
        held[:k] = np.arange(k)
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            src, dst = self.src[lo:hi], self.dst[lo:hi]
            live = count[src] > 0
            src, dst = src[live], dst[live]
            if not len(src):
                continue
            new = np.concatenate([[True], dst[1:] != dst[:-1]])
            ends, place = dst[new], np.cumsum(new) - 1
            src, place = np.concatenate([src, ends]), np.concatenate([place, np.arange(len(ends))])  # a start has its own list before
            many = count[src]
            if size + many.max() > most or many.sum() > 2 * most:
                return None
            new = distinct(np.repeat(place * k, many) + held[spans(first[src], many)])
            if size + len(new) > most:
                return None
            held[size : size + len(new)] = new % k
            count[ends] = np.bincount(new // k, minlength=len(ends))
            first[ends] = size + np.cumsum(count[ends]) - count[ends]
            size += len(new)
        return np.repeat(np.arange(self.n), count), held[spans(first, count)].astype(np.int64)


def _by_start(bits: np.ndarray, n: int) -> np.ndarray:
    """Bits as booleans, a column for each start."""
    return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _closure_rows(edge: DataFrame, ends: DataFrame | None) -> DataFrame:
    """src, dst, over, only, end: one row for each two nodes."""
    over = (F.col("type") == "OVERRIDES") if "type" in edge.columns else F.lit(False)
    rows = edge.where("src <> dst").groupBy("src", "dst").agg(F.bool_or(over).alias("over"), F.bool_and(over).alias("only"))
    if ends is None:
        return rows.withColumn("end", F.lit(False))
    # an end is marked on the edges that leave it: what an edge does not leave depends on nothing
    return rows.join(ends.select(F.col("id").alias("src"), F.lit(True).alias("end")).distinct(), "src", "left").withColumn("end", F.coalesce("end", F.lit(False)))


#: Graphs of more nodes have lists of what starts reach, so many entries at once.
LISTED, LISTS = 2048, 1 << 19
CLOSURE = "id long, dependents long, dependencies long, reaches_endpoint boolean, component long"


def weak(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that links a - b lead each of n nodes to, whichever way."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
    return least


def _closure_of(starts: pa.Table, links: pa.Table, chunk: int = 1024) -> pa.Table:
    """CLOSURE of the starts over links that fit a task. Weakly connected pieces are closed by themselves, small ones some
    chunk nodes together: no start meets the nodes of all pieces."""
    every = np.sort(starts["id"].to_numpy())
    src, dst, *marks = (links[c].to_numpy() for c in ("src", "dst", "over", "only", "end"))
    nodes = distinct(np.concatenate([src, dst]))
    n = len(nodes)
    out = {"id": every, "dependents": np.zeros(len(every), np.int64), "dependencies": np.zeros(len(every), np.int64), "reaches_endpoint": np.zeros(len(every), bool), "component": every.copy()}
    at = np.searchsorted(nodes, every)
    known = np.flatnonzero((at < n) & (nodes[np.minimum(at, n - 1)] == every)) if n else np.zeros(0, np.int64)
    if not len(known):
        return pa.table(out)
    a, b = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    _, piece, size = np.unique(weak(n, a, b), return_inverse=True, return_counts=True)
    lot = np.where(size < chunk, -1 - np.cumsum(np.where(size < chunk, size, 0)) // chunk, np.arange(len(size)))[piece]
    of_start, of_link = lot[at[known]], lot[a]
    order, turn = np.argsort(of_link, kind="stable"), np.argsort(of_start, kind="stable")
    lots, first = np.unique(of_start[turn], return_index=True)
    bounds = np.searchsorted(of_link[order], np.stack([lots, lots + 1], axis=1))
    for (lo, hi), mine in zip(bounds, np.split(known[turn], first[1:]), strict=True):
        some = order[lo:hi]
        for name, x in _closed(every[mine], src[some], dst[some], *(m[some] for m in marks), chunk).items():
            out[name][mine] = x
    return pa.table(out)


def _closed(every: np.ndarray, src: np.ndarray, dst: np.ndarray, over: np.ndarray, only: np.ndarray, end: np.ndarray, chunk: int) -> dict[str, np.ndarray]:
    """The columns of CLOSURE but id for starts that links have. Strongly connected components, of nodes and of states on the
    way up, are one node each, and what they hold is counted by their sizes. What starts reach are lists, or, in small graphs
    and where lists are long, bits that stand for starts."""
    nodes = distinct(np.concatenate([src, dst]))
    n, out = len(nodes), {}
    at, a, b = (np.searchsorted(nodes, x).astype(np.int32) for x in (every, src, dst))

    def counted(states: int, frm: np.ndarray, to: np.ndarray, part: np.ndarray, of: np.ndarray, count: Callable[[np.ndarray, int], np.ndarray], listed: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
        """count of what each of the states reaches, as bits by component and start, or listed, as pairs of them."""
        pairs = distinct(part[frm].astype(np.int64) * states + part[to])
        frm, to = (pairs // states).astype(np.int32), (pairs % states).astype(np.int32)
        frm, to, pairs = frm[frm != to], to[frm != to], None
        parts = int(part.max()) + 1
        seeds, back = np.unique(part[of], return_inverse=True)
        links, found, lo, some = Layers(parts, frm, to) if parts > LISTED else None, [], 0, len(seeds)
        while links is not None and lo < len(seeds):
            got = links.reached(seeds[lo : lo + some], LISTS)
            if got is not None:
                found.append(listed(*got, len(seeds[lo : lo + some])))
                lo += some
            elif some <= chunk:
                break
            else:
                some = max(chunk, some // 4)
        if lo < len(seeds):
            graph = BitGraph(parts, frm, to)
            wide = max(64, min(chunk, (1 << 27) // graph.states))  # tables of bits stay near 16 MB
            found += [count(graph.reach(seeds[x : x + wide]), len(seeds[x : x + wide])) for x in range(lo, len(seeds), wide)]
        return np.concatenate(found, axis=-1)[..., back]

    def total(weights: np.ndarray, bits: np.ndarray, k: int, *rows: np.ndarray) -> np.ndarray:
        """Sums of weights by start, of the rows of bits or of those that any of rows names; whole numbers under 2^24 at a time."""
        out, step = np.zeros(k, np.int64), max(1, (1 << 22) // k)
        for lo in range(0, len(weights), step):
            some = bits[lo : lo + step] if not rows else np.bitwise_or.reduce([bits[r[lo : lo + step]] for r in rows])
            out += (weights[lo : lo + step].astype(np.float32) @ _by_start(some, k).astype(np.float32)).astype(np.int64)
        return out

    def summed(weights: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
        return np.bincount(start, weights, minlength=k).astype(np.int64)

    part = strong(n, a, b)
    sizes = np.bincount(part)
    out["dependencies"] = counted(n, a, b, part, at, lambda bits, k: total(sizes, bits, k), lambda node, start, k: summed(sizes[node], start, k)) - 1
    out["component"] = nodes[np.unique(part, return_index=True)[1][part[at]]]
    # states of the way up: a node, and n on, a node that stands in for an overrider
    stands = np.zeros(n, bool)
    stands[b[over]] = True
    back, more = ~only & stands[b], over & stands[a]
    frm, to = np.concatenate([b, n + b[back], a[over], n + a[more]]), np.concatenate([a, a[back], n + b[over], n + b[more]])
    state = strong(2 * n, frm, to)
    marks = np.zeros(n, bool)
    marks[a[end]] = True
    held = np.bincount(state[:n][marks], minlength=int(state.max()) + 1)
    both, many = np.unique(state[:n].astype(np.int64) * len(held) + state[n:], return_counts=True)
    both = both // len(held), both % len(held)  # a node counts once, whichever of its states is reached
    plain = np.bincount(state[:n], minlength=len(held))
    apart = np.flatnonzero(both[0] != both[1])
    apart = apart[np.argsort(both[1][apart], kind="stable")]
    first = np.searchsorted(both[1][apart], np.arange(len(held) + 1))

    def listed(node: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
        """As counted: nodes by their plain states, and those of which only the other one is reached."""
        times = first[node + 1] - first[node]
        pair, who = apart[spans(first[node], times)], np.repeat(start, times)
        key = both[0][pair] * k + who
        have = node * np.int64(k) + start
        new = have[np.minimum(np.searchsorted(have, key), max(len(have) - 1, 0))] != key
        return np.stack([summed(plain[node], start, k) + summed(many[pair[new]], who[new], k), summed(held[node], start, k)])

    up, ends = counted(2 * n, frm, to, state, at, lambda bits, k: np.stack([total(many, bits, k, *both), total(held, bits, k)]), listed)
    out["dependents"] = up - 1
    out["reaches_endpoint"] = ends > marks[at]
    return out


def _packed_closure(spark: SparkSession, entity: DataFrame, edge: DataFrame, ends: DataFrame, max_edges: int) -> DataFrame:
    """CLOSURE of a graph of any size: pieces that fit a task there, larger ones by `_large_closure`."""
    rows = written(spark, _closure_rows(edge, ends))
    node = packed(spark, rows, max_edges)
    fit = node.where("pack is not null")
    found = by_packs(spark, fit, rows.join(fit.withColumnRenamed("id", "src").hint("merge"), "src"), _closure_of, CLOSURE, True)
    rest = node.where("pack is null").select("id")
    if not rest.isEmpty():
        found = found.unionByName(_large_closure(spark, rest, edge.join(rest.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi"), ends))
    none = F.lit(0).cast("long")
    every = entity.select(F.col("id").cast("long").alias("id")).distinct().join(found.hint("merge"), "id", "left")
    return every.select("id", F.coalesce("dependents", none).alias("dependents"), F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("reaches_endpoint", F.lit(False)).alias("reaches_endpoint"), F.coalesce("component", "id").alias("component"))


def _reached_bits(spark: SparkSession, starts: DataFrame, step: DataFrame) -> DataFrame:
    """node, block, word: which starts (id, block, bit) reach each node by steps (frm, to); rows of a node and block have different
    bits. Rounds are as many as the longest of all shortest routes."""
    front = written(spark, starts.select(F.col("id").alias("node"), "block", _own()))
    seen, step = [front], step.withColumnRenamed("frm", "node")
    while not front.isEmpty():
        moved = step.join(front.hint("merge"), "node").select(F.col("to").alias("node"), "block", "word")
        front = _gained(spark, moved, seen, ["node", "block"])
        seen.append(front)
    return _all(seen)


def _bit_counts(bits: DataFrame, starts: DataFrame, name: str) -> DataFrame:
    """id, name: the sum of n over the rows (block, word, n) that have each start's bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, word, n = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(block, kind="stable")
            block, first = np.unique(block[order], return_index=True)
            if not len(block):
                continue
            on = np.unpackbits(np.ascontiguousarray(word[order]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(on * n[order][:, None], first, axis=0)
            at, bit = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(block[at]), pa.array(bit.astype(np.int64)), pa.array(sums[at, bit])], names=["block", "bit", "n"])

    counted = bits.select("block", "word", F.col("n").cast("long").alias("n")).mapInArrow(run, "block long, bit long, n long").groupBy("block", "bit").agg(F.sum("n").alias(name))
    return starts.join(counted.hint("merge"), ["block", "bit"]).select("id", name)


def _large_closure(spark: SparkSession, entity: DataFrame, edge: DataFrame, ends: DataFrame) -> DataFrame:
    """As `_closure_of`, by joins. Strongly connected components become one, first of nodes, then of states on the way up (a
    component of nodes, or a node that stands in for an overrider), and what they reach is counted with their sizes: rows
    of bits are for what is left, not for nodes."""
    over = (F.col("type") == "OVERRIDES") if "type" in edge.columns else F.lit(False)
    rows = written(spark, edge.where("src <> dst").groupBy("src", "dst").agg(F.bool_or(over).alias("over"), F.bool_and(over).alias("only")))
    node = rows.select(F.col("src").cast("long").alias("id")).union(rows.select(F.col("dst").cast("long").alias("id"))).distinct()
    node = written(spark, node.select("id", F.monotonically_increasing_id().alias("n")))
    rows = rows.join(node.select(F.col("id").alias("src"), F.col("n").alias("a")).hint("merge"), "src").join(node.select(F.col("id").alias("dst"), F.col("n").alias("b")).hint("merge"), "dst")
    rows = written(spark, rows.select("a", "b", "over", "only"))
    part = _joined(spark, node.select(F.col("n").alias("id")), rows.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    node = written(spark, node.join(part.select(F.col("id").alias("n"), F.col("component").alias("c")).hint("merge"), "n"))
    of = lambda n, c: node.select(F.col("n").alias(n), F.col("c").alias(c)).hint("merge")
    rows = written(spark, rows.join(of("a", "x"), "a").join(of("b", "y"), "b"))
    # down: by components
    size = node.groupBy(F.col("c").alias("node")).agg(F.count("*").alias("n"), F.min("id").alias("component"))
    starts = _numbered(spark, size.select(F.col("node").alias("id")))
    reached = _reached_bits(spark, starts, written(spark, rows.where("x <> y").select(F.col("x").alias("frm"), F.col("y").alias("to")).distinct()))
    below = _bit_counts(reached.join(size.hint("merge"), "node"), starts, "below").withColumnRenamed("id", "c")
    # up: a component is the state 2 c, a node that something overrides 2 n + 1
    held = rows.where("over").select("b").distinct()
    link = lambda where, frm, to: where.select(F.expr(frm).alias("src"), F.expr(to).alias("dst"))
    steps = link(rows.where("x <> y"), "2 * y", "2 * x").union(link(rows.where("not only").join(held.hint("merge"), "b", "left_semi"), "2 * b + 1", "2 * x"))
    steps = steps.union(link(rows.where("over"), "2 * x", "2 * b + 1")).union(link(rows.where("over").join(held.select(F.col("b").alias("a")).hint("merge"), "a", "left_semi"), "2 * a + 1", "2 * b + 1"))
    steps = written(spark, steps.distinct())
    states = node.select((2 * F.col("c")).alias("id")).distinct().union(held.select((2 * F.col("b") + 1).alias("id")))
    state = written(spark, _joined(spark, states, steps))
    by = lambda c, k: state.select(F.col("id").alias(c), F.col("component").alias(k)).hint("merge")
    steps = steps.join(by("src", "frm"), "src").join(by("dst", "to"), "dst").where("frm <> to").select("frm", "to").distinct()
    node = node.withColumns({"src": 2 * F.col("c"), "dst": 2 * F.col("n") + 1}).join(by("src", "plain"), "src").join(by("dst", "flagged"), "dst", "left").drop("src", "dst")
    end = ends.select(F.col("id").cast("long").alias("id"), F.lit(1).alias("own")).distinct()
    node = written(spark, node.join(end.hint("merge"), "id", "left").withColumn("own", F.coalesce("own", F.lit(0))))
    starts = _numbered(spark, node.select(F.col("plain").alias("id")).distinct())
    reached = _reached_bits(spark, starts, written(spark, steps))
    # a node counts once, whichever of its states is reached
    group = node.groupBy("plain", F.when(F.col("flagged") != F.col("plain"), F.col("flagged")).alias("flagged")).agg(F.count("*").alias("n"))
    group = written(spark, group.withColumn("p", F.monotonically_increasing_id()))
    either = group.select("p", "n", F.col("plain").alias("node")).union(group.where("flagged is not null").select("p", "n", F.col("flagged").alias("node")))
    hit = reached.join(either.hint("merge"), "node").groupBy("p", "block").agg(F.bit_or("word").alias("word"), F.max("n").alias("n"))
    above = _bit_counts(hit, starts, "above").withColumnRenamed("id", "plain")
    marked = node.groupBy(F.col("plain").alias("node")).agg(F.sum("own").alias("n")).where("n > 0")
    exposed = _bit_counts(reached.join(marked.hint("merge"), "node"), starts, "ends").withColumnRenamed("id", "plain")
    out = node.join(above.hint("merge"), "plain").join(exposed.hint("merge"), "plain", "left").join(below.hint("merge"), "c").join(size.select(F.col("node").alias("c"), "component").hint("merge"), "c")
    # each start reaches itself, by a plain state
    out = out.select("id", (F.col("above") - 1).alias("dependents"), (F.col("below") - 1).alias("dependencies"), (F.coalesce("ends", F.lit(0)) > F.col("own")).alias("reaches_endpoint"), "component")
    every = entity.select(F.col("id").cast("long").alias("id")).distinct().join(out.hint("merge"), "id", "left")
    none = F.lit(0).cast("long")
    return every.select("id", F.coalesce("dependents", none).alias("dependents"), F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("reaches_endpoint", F.lit(False)).alias("reaches_endpoint"), F.coalesce("component", "id").alias("component"))


def closure(spark: SparkSession, entity: DataFrame, edge: DataFrame, endpoints: DataFrame | None = None, max_edges: int = MAX_LINKS) -> DataFrame:
    """id, dependents (reached upstream with dispatch), dependencies (downstream), reaches_endpoint (an endpoint among the
    dependents that a plain edge reaches), component (least id of its strongly connected component)."""
    edge = written(spark, edge)
    ends = endpoints if endpoints is not None else entity.where("kind = 'ENDPOINT'").select("id")
    if edge.count() > max_edges:
        return _packed_closure(spark, entity, edge, ends, max_edges)
    return by_blocks(spark, written(spark, entity.select(F.col("id").cast("long").alias("id")).distinct()), _closure_rows(edge, ends), _closure_of, CLOSURE)


def closure_counts(spark: SparkSession, entity: DataFrame, edge: DataFrame, endpoints: DataFrame | None = None, **options) -> DataFrame:
    return closure(spark, entity, edge, endpoints, **options).drop("component")


def _depths_of(starts: pa.Table, links: pa.Table) -> pa.Table:
    """component, depth of the starts over links (a, b; no cycles) that fit a task."""
    ids, ends = starts["id"].to_numpy(), [links[c].to_numpy() for c in ("a", "b")]
    nodes = np.unique(np.concatenate([ids, *ends]))
    a, b = (np.searchsorted(nodes, x) for x in ends)
    return pa.table({"component": starts["id"], "depth": pa.array(longest(len(nodes), b, a)[np.searchsorted(nodes, ids)], pa.int32())})


def _components_of(starts: pa.Table, links: pa.Table) -> pa.Table:
    nodes, ends = np.unique(np.concatenate([links["src"].to_numpy(), links["dst"].to_numpy()]), return_inverse=True)
    part = strong(len(nodes), ends[: len(links)], ends[len(links) :])
    return pa.table({"id": nodes, "component": nodes[np.unique(part, return_index=True)[1][part]]})


def components(spark: SparkSession, entity: DataFrame, edge: DataFrame, max_edges: int = MAX_LINKS) -> DataFrame:
    """id, component: the least id of its strongly connected component.

    Nodes without edges in or out among those left are components of their own and are trimmed. The others take the least
    id that reaches them; of those of one colour, what reaches the colour's own node is its component, and the rest goes
    on.
    """
    links = written(spark, edge.select("src", "dst").where("src <> dst").distinct())
    if links.count() <= max_edges:
        node = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct().withColumn("pack", F.lit("all"))
    else:
        node = packed(spark, links, max_edges)
    fit, rest = node.where("pack is not null"), node.where("pack is null").select("id")
    found = by_packs(spark, fit, links.join(fit.withColumnRenamed("id", "src").hint("merge"), "src"), _components_of, "id long, component long", False)
    if not rest.isEmpty():
        found = found.unionByName(_joined(spark, rest, links.join(rest.withColumnRenamed("id", "src").hint("merge"), "src", "left_semi")))
    return entity.select(F.col("id").cast("long").alias("id")).distinct().join(found.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _joined(spark: SparkSession, ids: DataFrame, links: DataFrame) -> DataFrame:
    """id, component of ids, by rounds over a table of distinct links (src, dst, no loops)."""
    named = lambda df, **names: df.select(*(F.col(c).alias(n) for n, c in names.items())).hint("merge")
    while True:  # trim
        live = written(spark, links.select(F.col("src").alias("id")).distinct().join(named(links, id="dst").distinct().hint("merge"), "id", "left_semi"))
        less = written(spark, links.join(named(live, src="id"), "src", "left_semi").join(named(live, dst="id"), "dst", "left_semi"))
        same = less.count() == links.count()
        links = less
        if same:
            break
    found = None
    left = links
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
        colour = written(spark, nodes.select("id", F.col("id").alias("colour")))
        new = colour
        while True:  # the least id that reaches each node; only nodes whose colour has changed pass it on
            near = left.join(named(new, src="id", c="colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("c"))
            next_ = written(spark, colour.join(near.hint("merge"), "id", "left").select("id", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("old")))
            new, colour = next_.where("colour <> old").select("id", "colour"), next_.select("id", "colour")
            if new.isEmpty():
                break
        inside = written(spark, left.join(named(colour, src="id", a="colour"), "src").join(named(colour, dst="id", b="colour"), "dst").where("a = b").select("src", "dst"))
        part = front = written(spark, colour.where("id = colour"))
        while not front.isEmpty():  # back from each colour's own node
            grown = inside.join(named(front, dst="id", colour="colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = written(spark, grown.join(named(part, id="id"), "id", "left_anti"))
            part = part.unionByName(front)
        part = written(spark, part)
        found = part if found is None else found.unionByName(part)
        left = written(spark, inside.join(named(part, src="id"), "src", "left_anti").join(named(part, dst="id"), "dst", "left_anti"))
    if found is None:
        return ids.withColumn("component", F.col("id"))
    return ids.join(named(found, id="id", component="colour"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def cycles(spark: SparkSession, entity: DataFrame, edge: DataFrame) -> DataFrame:
    """component, size, members (sorted) of components of two nodes or more."""
    return components(spark, entity, edge).groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("id")).alias("members")).where("size > 1")


def depths(spark: SparkSession, entity: DataFrame, edge: DataFrame, component: DataFrame | None = None, max_edges: int = MAX_LINKS) -> DataFrame:
    """id, component, depth: edges of the longest chain of components from its own to a sink."""
    part = written(spark, component if component is not None else components(spark, entity, edge))
    a, b = part.select(F.col("id").alias("src"), F.col("component").alias("a")).hint("merge"), part.select(F.col("id").alias("dst"), F.col("component").alias("b")).hint("merge")
    links = written(spark, edge.join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct())
    if links.count() <= max_edges:
        best, front = by_blocks(spark, links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct(), links, _depths_of, "component long, depth int"), None
    else:
        node = packed(spark, links.select(F.col("a").alias("src"), F.col("b").alias("dst")), max_edges)
        fit = node.where("pack is not null")
        best = by_packs(spark, fit, links.join(fit.withColumnRenamed("id", "a").hint("merge"), "a"), _depths_of, "component long, depth int", False)
        links = written(spark, links.join(node.where("pack is null").select(F.col("id").alias("a")).hint("merge"), "a", "left_semi"))
        front = links.select(F.col("b").alias("component")).distinct().withColumn("depth", F.lit(0))
        best = best.unionByName(front)
    d = 0
    while front is not None and not front.isEmpty():  # a node is in round d if a chain of d edges leaves it: rounds are as many as the longest chain
        d += 1
        front = written(spark, links.join(front.select(F.col("component").alias("b")).hint("merge"), "b", "left_semi").select(F.col("a").alias("component")).distinct().withColumn("depth", F.lit(d)))
        best = best.unionByName(front)
    best = best.groupBy("component").agg(F.max("depth").alias("depth"))
    return part.join(best.hint("merge"), "component", "left").select("id", "component", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def neighbourhood(spark: SparkSession, entity: DataFrame, edge: DataFrame, risk: DataFrame, focus: DataFrame | None = None, depth: int = 2, max_nodes: int = 500, tests: bool = False) -> DataFrame:
    """id, distance, risk of the nodes of a view: those around the focus, or else the riskiest; truncated if there are more."""
    depth, max_nodes = min(max(depth, 1), 6), min(max(max_nodes, 1), 500)
    own = owners(entity).join(entity.select(F.col("id").alias("owner_id"), F.col("stereotype").alias("role")), "owner_id", "left").select("id", F.coalesce(F.col("role") == "TEST", F.lit(False)).alias("test"))
    scored = entity.select("id").join(risk.select("id", "risk"), "id", "left").withColumn("risk", F.coalesce("risk", F.lit(0.0)))
    if focus is None:
        near = scored.orderBy(F.desc("risk"), "id").limit(2 * max_nodes).select("id", F.lit(-1).alias("distance"))
        keep = F.lit(False)
    else:
        up, down = (bfs(spark, edge, focus, d, depth) for d in (UPSTREAM, DOWNSTREAM))
        near = up.unionByName(down).groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("distance"))
        keep = F.col("distance") == 0
    out = near.join(scored, "id").join(own, "id")
    if not tests:
        out = out.where(~F.col("test") | keep)
    out = written(spark, out.select("id", "distance", "risk"))
    many = out.count()
    ordered = out.orderBy(F.greatest("distance", F.lit(0)), F.desc("risk"), "id").limit(max_nodes)
    return ordered.withColumn("truncated", F.lit(many > max_nodes))


def induced(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edge.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def merged_view(edge: DataFrame) -> DataFrame:
    """src, dst, types (sorted), weight, main_type: one arrow for each pair of nodes."""
    order = F.array(*(F.lit(x) for x in ("EXTENDS", "IMPLEMENTS", "OVERRIDES", "CALLS", "CREATES", "USES_TYPE", "IMPORTS", "ANNOTATED_BY", "ROUTES_TO")))
    first: Column = F.min(F.struct(F.array_position(order, F.col("type")).alias("at"), "type"))["type"]
    return edge.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.sum("weight").cast("long").alias("weight"), first.alias("main_type"))
