import numpy as np
import pytest

from graphloom.operators import retrieval
from graphloom.operators.balls import Balls


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(6)
    centres = r.standard_normal((12, 16))
    vectors = [(i, (centres[i % 12 if i % 3 else 0] + 0.15 * r.standard_normal(16)).tolist()) for i in range(900)]  # a third in one ball
    vectors += [(1000 + i, vectors[5][1]) for i in range(30)]  # ties
    return [*vectors, (2000, [0.0] * 16), (2001, None), (2002, []), (2003, [1.0, 2.0]), (2004, [2.0, 1.0]), (2005, [-x for x in vectors[0][1]])]


@pytest.mark.parametrize(("k", "pivots"), [(1, 64), (10, 64), (10, 1), (2000, 8)])
def test_as_comparing_with_all(spark, rows, k, pivots):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 90 = 0 or vec_id >= 1029").withColumnRenamed("vec_id", "query_id")
    key = lambda df: sorted((r.query_id, r.vec_id, r.dense) for r in df.collect())
    got, share = Balls(spark, vectors, pivots=pivots).top(queries, k)
    assert key(got) == key(retrieval.dense_top(vectors, queries, k))
    assert 0 < share <= 1
    if k == 10 and pivots == 64:
        assert share < 0.5


def test_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert Balls(spark, none).top(none.withColumnRenamed("vec_id", "query_id"))[0].collect() == []


def test_only_pivots_come_to_the_driver(spark, rows, monkeypatch):
    """A limit that is collected has as many vectors of each task sent there."""
    from graphloom.operators import balls

    seen, written = [], balls.written
    monkeypatch.setattr(balls, "written", lambda spark, df: (seen.append((df.columns, df.count())), written(spark, df))[1])
    balls.Balls(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), pivots=9)
    assert seen[0] == (["v"], 9)
