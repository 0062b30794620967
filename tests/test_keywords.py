import random

import pytest

from graphloom.operators import keywords, retrieval


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    words = [f"{a}{b}word" for a in ("alpha", "beta", "gamma", "delta", "Zeta") for b in "xyz"]
    weights = [40, 30, 20, 10, 5, 3, *[1] * 9]
    say = lambda n: " ".join(r.choices(words, weights, k=n))
    chunks = [(i, f"Label{r.choice(words)}", f"p.{r.choice(words)}", say(r.randint(0, 12)) if i % 10 else None) for i in range(400)]
    asked = [(i, say(r.randint(1, 6))) for i in range(12)] + [(50, "nothingknown here"), (51, ""), (52, None), (53, "alphaxword " * 3)]
    return spark.createDataFrame(chunks, "id long, label string, qualified_name string, text string"), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize(("k", "terms"), [(1, 50_000), (7, 50_000), (7, 3), (1000, 50_000)])
def test_as_the_full_product(tables, monkeypatch, k, terms):
    monkeypatch.setattr(keywords, "TERMS", terms)
    chunks, asked = tables
    want = {}
    for r in retrieval.keyword_scores(chunks, asked).where("keyword > 0").collect():
        want.setdefault(r.query_id, []).append((-r.keyword, r.id))
    want = sorted((q, i, -s) for q, rows in want.items() for s, i in sorted(rows)[:k])
    found, scored = keywords.top(chunks, asked, k)
    assert sorted((r.query_id, r.id, r.keyword) for r in found.collect()) == want
    if k == 1:
        assert scored < chunks.count() * asked.count()


def test_nothing(spark, tables):
    chunks, asked = tables
    assert keywords.top(chunks.where("false"), asked)[0].collect() == [] and keywords.top(chunks, asked.where("false"))[0].collect() == []


@pytest.mark.parametrize("most", [1000, 5])
def test_scores_of_one_scan(tables, monkeypatch, most):
    """Scores of all questions without a join of chunks and questions."""
    monkeypatch.setattr(keywords, "QUESTIONS", most)
    chunks, asked = tables
    got = keywords.scores(chunks, asked)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.keyword_scores(chunks, asked).collect()))
    assert keywords.scores(chunks, asked.where("false")).collect() == []


def test_lists_of_a_few_chunks_at_a_time(tables, monkeypatch):
    chunks, asked = tables
    want = {tuple(x) for x in keywords.lists(chunks, ["alphaxword", "betayword"]).collect()}
    monkeypatch.setattr(keywords, "ROWS", 3)
    assert {tuple(x) for x in keywords.lists(chunks.coalesce(1), ["alphaxword", "betayword"]).collect()} == want and want
