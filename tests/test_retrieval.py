"""Search for many queries at once: each has its own best rows."""

import os
from collections import Counter

import numpy as np
import pytest

from graphloom import catalogue
from graphloom.operators import retrieval

SF = "/root/testdata/sf0.001"


def test_every_query_has_its_nearest(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 8)).round(2)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = vectors.where("vec_id % 100 = 0").selectExpr("vec_id query_id", "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in (0, 100, 200):
        dense = np.floor(unit @ unit[q] * 10000 + 0.5) / 10000
        want |= {(q, int(i), float(dense[i])) for i in np.lexsort((np.arange(300), -dense))[:7]}
    assert {tuple(x) for x in retrieval.dense_top(vectors, asked, 7).collect()} == want


def test_every_query_has_its_ranking(spark):
    c = spark.createDataFrame([(i, f"L{i}", "q", w) for i, w in enumerate(["apple pie", "banana", "cherry", "apple"])], "id long, label string, qualified_name string, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "cherry")], "query_id long, text string")
    dense = spark.createDataFrame([(1, 1, 0.1), (1, 0, 0.5), (2, 0, 0.2), (2, 2, 0.2)], "query_id long, id long, dense double")
    owned, pinned = spark.createDataFrame([(1, 3), (2, 3)], "query_id long, id long"), spark.createDataFrame([(2, 1)], "query_id long, id long")
    pool = retrieval.candidates(dense, c, asked, owned, pinned, 2)
    got = {(x.query_id, x.id, x.score) for x in retrieval.hybrid(pool, 2).collect()}
    assert got == {(1, 0, 0.44), (1, 3, 0.09), (2, 1, 1.0), (2, 2, 0.23)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_all_questions_and_vectors_are_asked(spark):
    got = catalogue.QUERIES["hybrid_rank_all"](spark, SF).collect()
    questions, vectors = (spark.read.parquet(f"{SF}/{t}.parquet").where(x).count() for t, x in (("benchmark", "true"), ("embeddings", "vec_id % 100 = 0")))
    assert Counter(r.query_id for r in got) == dict.fromkeys(range(max(questions, vectors)), 8)
    assert all({r.id for r in got if r.query_id == q and r.pinned} <= {3, 11, 200} for q in range(questions))


def test_texts_and_vectors_that_queries_share_are_asked_once(spark, monkeypatch):
    """The same ranking as over every query's own chunks, with keywords of those chunks by text, not by query."""
    from graphloom.plans import retrieval_queries

    r = np.random.default_rng(8)
    words = ["apple", "banana", "cherry", "grape", "melon"]
    c = spark.createDataFrame([(i, f"L{i}", "q", " ".join(r.choice(words, 3))) for i in range(150)], "id long, label string, qualified_name string, text string")
    texts = spark.createDataFrame([(0, "apple grape"), (1, "melon"), (2, "of")], "query_id long, text string")
    dense = spark.createDataFrame([(q, int(i), float(x)) for q in range(4) for i, x in zip(r.permutation(150)[:9], r.random(9).round(2), strict=True)], "query_id long, id long, dense double")
    every = spark.range(12).selectExpr("id query_id", "id % 3 text_n", "id % 4 ask_n")
    owned, pinned = c.where("id % 2 = 0").select("id"), c.where("id in (4, 7)").select("id")
    own = every.join(dense.withColumnRenamed("query_id", "ask_n"), "ask_n").select("query_id", "id", "dense")
    asked = every.join(texts.withColumnRenamed("query_id", "text_n"), "text_n").select("query_id", "text")
    want = retrieval.hybrid(retrieval.candidates(own, c, asked, *(x.join(every.select("query_id"), how="cross") for x in (owned, pinned)), 2), 2)
    pairs, scores = [], retrieval.keyword_scores
    monkeypatch.setattr(retrieval, "keyword_scores", lambda chunks, query, asked: (pairs.append(asked.count()), scores(chunks, query, asked))[1])
    got = retrieval.hybrid(retrieval_queries.questions_together(spark, every, texts, dense, c, owned, pinned, 2), 2)
    key = lambda df: sorted((x.query_id, x.id, x.dense, x.keyword, x.pinned, x.score) for x in df.collect())
    assert key(got) == key(want) and len(key(got)) == 24 and pairs[0] <= 12 * (8 + 2)
