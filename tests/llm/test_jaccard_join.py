import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import common, jaccard_join
from graphloom.llm.components import components

KINDS = "doc_id long, text string, set string, n long, cluster int"


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """doc_id, n_shingles, n_links, class_id, by links between all pairs; None is the least id."""
    sets = [shingles(t) for _, t, *_ in rows]
    n = len(rows)
    linked = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for i in range(n):
        stack = [i]
        while stack:
            x = stack.pop()
            for y in range(n):
                if linked[x][y] and label[y] > label[i]:
                    label[y] = label[i]
                    stack.append(y)
    least = {}
    key = lambda d: (d is not None, d or 0)
    for i in range(n):
        least[label[i]] = min(least.get(label[i], rows[i][0]), rows[i][0], key=key) if label[i] in least else rows[i][0]
    return Counter((rows[i][0], len(sets[i]), sum(linked[i]), least[label[i]]) for i in range(n))


@pytest.fixture(scope="module")
def near_rows():
    r = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice([3, 7, 40, 120, 300]))] for _ in range(30)]
    passage = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        if i % 9 == 0:
            w += passage
        rows.append((i, " ".join(w), "x", 1, 2))
    many = [r.choice(words) for _ in range(150)]
    for i in range(200, 330):
        w = list(many)
        w[r.randrange(150)] = r.choice(words)
        rows.append((i, "\n".join(w), "x", 1, 2))
    return [*rows, (900, None, None, None, None), (901, "", "", 1, 1), (902, " ", "", 1, 1), rows[4], (None, rows[6][1], None, None, None)]


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.n_links, r.class_id) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"small": 4, "block": 32, "exact_block": 8}])
def test_against_all_pairs(spark, near_rows, options):
    got, want = result(jaccard_join.join(spark, spark.createDataFrame(near_rows, KINDS).repartition(3), **options)), brute(near_rows)
    assert sum((got & want).values()) >= 0.99 * sum(want.values())
    assert sum(got.values()) == sum(want.values())


def test_joined_by_shuffle(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert result(jaccard_join.join(spark, docs)) == brute(rows)


def test_keeps_one_of_each_class(spark, near_rows):
    docs = spark.createDataFrame(near_rows, KINDS)
    out = jaccard_join.keep_one(spark, docs)
    assert out.columns == docs.columns
    classes = {(c if n else d) for d, _, n, c in brute(near_rows)}
    assert abs(out.where("doc_id < 900 or doc_id is null").count() - len({c for d, k, _, c in brute(near_rows) if k})) <= 2
    assert {900, 901, 902} <= {r.doc_id for r in out.collect()} and classes


def test_corpus(spark, docs, rows):
    assert result(jaccard_join.join(spark, docs)) == brute(rows)


def test_empty(spark, none):
    assert jaccard_join.join(spark, none).collect() == [] == jaccard_join.keep_one(spark, none).collect()


def test_tokens_estimate_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 62, 200).astype(np.uint64)])
    s = jaccard_join.sketches(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 0), (7, 7), (500, 500)]
    got = {r.id: r.label for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 100: 0, 500: 500, 40: 40} or got == {**{i: i // 10 * 10 for i in range(40)}, 100: 0, 500: 500}


def test_overlaps_of_nothing():
    none = np.zeros(0, np.uint64)
    assert jaccard_join.overlaps([none, none]).tolist() == [[0, 0], [0, 0]]
    assert jaccard_join.overlaps([none, np.array([3, 5], np.uint64)]).tolist() == [[0, 0], [0, 2]]
