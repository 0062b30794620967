import re
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] >= most * sizes[s]}
        if not over:
            return out | {s: unit * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def test_mix(spark, docs, rows):
    got = mixing.mix(spark, docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    want = filled(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, size(t)) for d, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 64
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(spark, docs.repartition(5)).collect()))


def test_mix_equals_sql(spark, docs, rows):
    got = mixing.mix(spark, docs).toPandas()
    documents = pd.DataFrame([(d, t, s) for d, t, _, s, *_ in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    with duckdb.connect() as c:
        c.register("documents", documents)
        want = c.sql(mixing.oracle()).df()
    key = lambda df: Counter(map(str, df[["doc_id", "source", "size", "source_size", "target", "taken", "shard"]].astype({"doc_id": "Int64"}).values.tolist()))
    assert key(got) == key(want)


def test_mix_gives_small_sources_their_words(spark):
    """Sources of very unlike sizes, few blocks: each has its target, or all that its shards have room for."""
    n = {"a": 3000, "b": 40, "c": 1, "d": 400, "e": 7}
    docs = spark.createDataFrame([(i, "w " * (20 + i % 13), s) for i, s in enumerate(s for s, k in n.items() for _ in range(k))], "doc_id long, text string, source string")
    taken, sizes, aim = defaultdict(int), defaultdict(int), {}
    for r in mixing.mix(spark, docs, blocks=64).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        aim[r.source] = r.target
    assert aim == pytest.approx(filled(dict(sizes)))
    assert all(abs(taken[s] - aim[s]) <= 1 + 0.001 * aim[s] for s in n), (taken, aim)


def test_mix_hands_on_what_full_shards_cannot_take(spark):
    """All sources as long as they may be, shards of few documents: nothing is lost to rounding in 64 shards."""
    docs = spark.createDataFrame([(i, "w " * (300 + i % 7), f"s{i % 4}") for i in range(4000)], "doc_id long, text string, source string")
    taken, aim = defaultdict(int), {}
    for r in mixing.mix(spark, docs, share=2, blocks=1 << 11).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        aim[r.source] = r.target
    block = min(aim.values()) // (32 * 64)
    assert all(abs(taken[s] - aim[s]) <= block for s in aim), (taken, aim)


def test_highest_ranks_few_quotients(spark):
    import random

    from pyspark.sql.window import Window

    r = random.Random(5)
    for n, seats in ((1, 9), (7, 1), (40, 23), (64, 9999), (300, 100), (200, 5000)):
        claims = {i: r.choice([0, 1, r.randint(1, 9), r.randint(1, 5000)]) or (i == 0) for i in range(n)}
        claims = {i: int(c) for i, c in claims.items()}
        best = sorted(((-c / (2 * j + 1), i) for i, c in claims.items() if c for j in range(seats)))[:seats]
        got = mixing.highest(spark.createDataFrame(list(claims.items()), "k long, claim long"), ["k"], "claim", seats, Window.partitionBy(F.lit(0)))
        assert {x.k: x.blocks for x in got.collect()} == dict(Counter(i for _, i in best))


def test_mixed_texts(spark, docs, rows):
    taken = mixing.mix(spark, docs)
    out = mixing.mixed(docs, taken)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += size(r.text)
    want = defaultdict(int)
    for r in taken.where("taken > 0").collect():
        want[r.doc_id] += r.taken
    assert words == want


def test_shards(spark, docs, rows):
    got = sharding.shard(spark, docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.shard(spark, docs.repartition(5)).collect()))


def draw(key, path, weight):
    return -math.log((int(hashlib.md5(f"{key}@{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight


def walked(key, weights, settled=None):
    """The shard of a key by walking the tree, regions of four shards, racks of two; shards beyond the settled ones stand alone."""
    added = {s: w for s, w in enumerate(weights) if settled is not None and s >= settled}
    weights = weights[:settled]
    inside = lambda lo, hi: range(lo, min(hi, len(weights)))
    heavy = lambda shards: sum(weights[s] for s in shards)
    options = {r: (f"region {r}", heavy(inside(4 * r, 4 * r + 4))) for r in range((len(weights) + 3) // 4)}
    at, region = min((draw(key, p, w), r) for r, (p, w) in options.items() if w)
    for s, w in added.items():
        if w and draw(key, f"added {s}", w) < at:
            at, region = draw(key, f"added {s}", w), -s
    if region < 0:
        return -region
    options = {k: (f"region {region}/rack {k}", heavy(inside(2 * k, 2 * k + 2))) for k in (2 * region, 2 * region + 1) if 2 * k < len(weights)}
    rack = min((draw(key, p, w), k) for k, (p, w) in options.items() if w)[1]
    return min((draw(key, f"region {region}/rack {rack}/shard {s}", weights[s]), s) for s in inside(2 * rack, 2 * rack + 2) if weights[s])[1]


def test_shards_by_brute_force(spark, docs, rows):
    got = Counter((r.doc_id, r.shard, r.grown_shard) for r in sharding.shard(spark, docs).collect())
    key = lambda d: "null" if d is None else d
    assert got == Counter((d, walked(key(d), [1.0] * 8), walked(key(d), [1.0] * 9, 8)) for d, *_ in rows)
    weights = [1, 0, 2.5, 1, 0, 0, 4, 1, 1, 3, 1]
    keys = spark.range(3000).selectExpr("cast(id as string) key")
    found = keys.select("key", sharding.descend(keys.key, weights).alias("s")).collect()
    assert [r.s for r in found] == [walked(r.key, weights) for r in found]


def test_tree_moves_rows_only_where_weights_change(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) key")
    old, new = [1, 2, 1, 1, 3, 1, 1, 2], [1, 2, 1, 1, 3, 2, 1, 2]
    rows = keys.select("key", sharding.descend(keys.key, old).alias("a"), sharding.descend(keys.key, new).alias("b"), sharding.descend(keys.key, [*old, 2]).alias("c")).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[s] / 20_000 - w / 12) < 0.02 for s, w in enumerate(old))
    # shard 5 has grown: nothing moves in region 0, and in region 1 between old rows only into rack 2, there only into shard 5
    assert all(r.b >= 4 for r in rows if r.a != r.b) and not any(r.a < 4 and r.b < 4 for r in rows if r.a != r.b)
    assert {(r.a, r.b) for r in rows if r.a != r.b and r.a >= 4} <= {(4, 5), (6, 4), (6, 5), (7, 4), (7, 5)}
    assert sum(r.a != r.b for r in rows) / 20_000 < 0.2
    assert {r.c for r in rows if r.a != r.c} == {8}
    # whatever the number of shards, one more takes rows only into itself
    for n in (1, 7, 9, 10, 11, 12):
        many = [1.0] * n
        rows_ = keys.select("key", sharding.descend(keys.key, many).alias("a"), sharding.descend(keys.key, [*many, 1.0], n).alias("b")).collect()
        moved = [r for r in rows_ if r.a != r.b]
        assert {r.b for r in moved} == {n} and abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.02
    # a descent, not the least of all shards' draws
    flat = lambda key: min((draw(key, f"region {s // 4}/rack {s // 2}/shard {s}", w), s) for s, w in enumerate(old))[1]
    assert sum(flat(r.key) != r.a for r in rows) > 5000


def counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, docs, rows):
    got = quality.judge(spark, docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS[:5])) for r in got) == Counter((d, *counts(t or "")) for d, t, *_ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert 0 <= r.quality <= 1 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_expectation_maximisation_finds_the_informative_rule():
    """Rule 0 tells the classes apart, rule 1 mostly, rule 2 is noise."""
    patterns = []
    for good, n in ((1, 9000), (0, 1000)):
        for a, pa in ((1 if good else -1, 0.95), (0, 0.05)):
            for b, pb in ((1 if good else -1, 0.8), (1 if not good else -1, 0.05), (0, 0.15)):
                for c, pc in ((1, 0.5), (-1, 0.02), (0, 0.48)):
                    patterns.append(((a, b, c), round(n * pa * pb * pc)))
    first, adds = quality.fit(patterns)
    assert first > 0 and adds[0][0] < -3 and adds[0][2] > 1 and abs(adds[2][0]) < 1.5


def test_posterior_by_brute_force(spark, docs):
    """Expectation-maximisation document by document, and Bayes' rule term by term."""
    rows = quality.judge(spark, docs).collect()
    votes = [r.votes for r in rows]
    m, n = len(votes[0]), len(votes)
    start = ({-1: 0.3, 0: 0.3, 1: 0.4}, {-1: 0.03, 0: 0.17, 1: 0.8})
    p, share, weight = [[dict(s) for _ in range(m)] for s in start], 0.9, max(1.0, 0.001 * n)

    def posterior(v):
        good, bad = share, 1 - share
        for j, x in enumerate(v):
            good, bad = good * p[1][j][x], bad * p[0][j][x]
        return good / (good + bad)

    for _ in range(200):
        post = [posterior(v) for v in votes]
        for c in (0, 1):
            w = [x if c else 1 - x for x in post]
            p[c] = [{x: (sum(wi for wi, v in zip(w, votes, strict=True) if v[j] == x) + weight * start[c][x]) / (sum(w) + weight) for x in (-1, 0, 1)} for j in range(m)]
        share = min(max(sum(post) / n, 1e-3), 1 - 1e-3)
    for r in rows:
        assert abs(r.quality - posterior(r.votes)) < 1e-9
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


@pytest.mark.parametrize("run", [mixing.mix, sharding.shard, quality.judge])
def test_empty(spark, none, run):
    assert run(spark, none).collect() == []


def test_lines_that_collide_in_plain_rolling_hashes_are_not_duplicates(spark):
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    rows = [(n, "\n".join(["".join("ab"[x] for x in t[:n]), "".join("ba"[x] for x in t[:n])] * (n // 1024))) for n in (1024, 2048, 4096)]
    got = {r.doc_id: r.n_dup_lines for r in quality.judge(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1024: 0, 2048: 2, 4096: 6}
