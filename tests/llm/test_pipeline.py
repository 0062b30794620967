"""The pipeline against brute force, stage by stage, and as a whole."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from graphloom.llm import quality
from graphloom.llm import sentencepiece_codec as sp
from tests.llm import test_jaccard_join, test_line_dedup
from tests.llm.conftest import KINDS, make_docs
from tests.llm.test_mixing_sharding_quality import filled, size


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = [r for s in range(1, 7) for r in [(None if d is None else d + 1000 * s, *x) for d, *x in make_docs(s)]]
    spark.createDataFrame(rows, KINDS).write.parquet(f"file://{at}/documents.parquet")
    return f"file://{at}"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary here")
def test_each_stage(spark, sf_dir):
    from graphloom.llm.common import table, written

    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf_dir, "documents")
    # quality: exactly the rows that the operator keeps, and none that fails the base rule
    kept = written(spark, stages["quality rules"](spark, docs, sf_dir))
    assert kept.columns == docs.columns
    verdict = quality.judge(spark, docs)
    assert Counter(r[0] for r in rows_of(kept)) == Counter(r.doc_id for r in verdict.where("kept").collect())
    # lines
    lined = written(spark, stages["line dedup"](spark, kept, sf_dir))
    assert lined.columns == docs.columns
    want = test_line_dedup.brute([r[:2] for r in rows_of(kept)])
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter((r[0], digest(r[1])) for r in rows_of(lined)) == Counter({(d, h): n for (d, _, _, h), n in want.items()})
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    # near duplicates: one row of each class
    unique = written(spark, stages["n-gram jaccard join"](spark, lined, sf_dir))
    classes = test_jaccard_join.brute(rows_of(lined))
    left = Counter(r[0] for r in rows_of(unique))
    assert unique.columns == docs.columns and set(left) >= {c for d, n, _, c in classes if n} and set(left) <= {d for d, *_ in classes}
    assert sum(left.values()) == len({c for _, n, _, c in classes if n}) + len({r[:2] for r in rows_of(lined) if not size(r[1])})
    # the mix
    mix = written(spark, stages["mixing sources"](spark, unique, sf_dir))
    assert mix.columns == docs.columns
    sizes, taken, each = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in unique.collect():
        sizes[r.source] += size(r.text)
    for r in mix.collect():
        taken[r.source] += size(r.text)
        each[r.doc_id] += size(r.text)
    for s, t in filled(dict(sizes)).items():
        assert abs(taken[s] - t) <= 0.02 * t + 64
    assert all(each[r.doc_id] <= 2 * size(r.text) for r in unique.collect() if left[r.doc_id] == 1)
    # tokens
    codec = sp.Codec(sp.load(sp.MODEL))
    out = stages["sentencepiece encoding"](spark, mix, sf_dir).collect()
    want = Counter((r.doc_id, tuple(codec.viterbi(sp.SPACE + r.text.replace(" ", sp.SPACE)) if r.text else ())) for r in mix.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want and all(r.round_trip for r in out)


@pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary here")
def test_run_is_the_stages_in_turn(spark, sf_dir):
    from graphloom.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, sf_dir))
    got = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(str, rows_of(got))) == Counter(map(str, rows_of(docs)))


def test_stages_on_nothing(spark, none):
    for name, stage in corpus_pipeline.STAGES:
        if os.path.exists(sp.MODEL) or "piece" not in name:
            assert stage(spark, none, "").collect() == []
