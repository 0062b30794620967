import math
import os
import random

import numpy as np
import pytest

from graphloom.llm import embedding_dedup
from graphloom.llm import sentencepiece_codec as sp

KINDS = "vec_id long, embedding array<float>, label int, `set` string, n int"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(8)
    base = r.standard_normal((12, 16)).astype(np.float32)
    rows = []
    for i in range(240):
        v = base[r.integers(12)] + r.choice([0, 0.05, 0.2, 0.3]) * r.standard_normal(16).astype(np.float32)
        rows.append((i, [float(np.float32(x)) for x in v * r.choice([1, 3])], int(r.integers(3)) if i % 11 else None, "x", 1))
    rows += [(300, None, 1, "", 1), (301, [0.0] * 16, 1, "", 1), (302, [math.nan] + [1.0] * 15, 1, "", 1), (303, [math.inf] + [1.0] * 15, 1, None, None)]
    rows += [(304, [None] + [1.0] * 15, 1, None, None), (305, [], 1, None, None), (306, [1.0, 2.0], 1, None, None), (307, [1.0, 2.0], 1, None, None)]
    return [*rows, rows[4], rows[4], (None, rows[5][1], 1, None, None), (310, rows[7][1], 2, None, None)]


def brute(rows):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab, *_ in rows]
    n = len(rows)

    def cosine(i, j):
        a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
        return len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93

    linked = [[i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and cosine(i, j) for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            x = stack.pop()
            for y in range(n):
                if linked[x][y] and y not in seen:
                    seen.add(y)
                    stack.append(y)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[i][0], int(sum(linked[i])), min(ids) if ids else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [16, 512])
def test_embeddings_against_all_pairs(spark, vectors, block):
    got = embedding_dedup.near_vectors(spark, spark.createDataFrame(vectors, KINDS).repartition(3), block=block).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_hot_copies_tiny_and_huge_components(spark):
    """Copies beyond `hot` are salted; squares of such components underflow or overflow as they stand."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0], 1, "", 1) for i in range(40)] + [(50, [1e-200, 2e-200, 3e-200, 4e-200], 1, "", 1), (51, [1e200, 2e200, 3e200, -4e200], 1, "", 1), (52, [1e-320, 0.0, 0.0, 0.0], 1, "", 1), (53, [1.0, 0.0, 0.0, 0.0], 1, "", 1)]
    rows += [(60 + i, None, 1, "", 1) for i in range(9)]
    got = embedding_dedup.near_vectors(spark, spark.createDataFrame(rows, KINDS.replace("array<float>", "array<double>")).repartition(3), hot=7).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 40, 0) for i in range(40)} | {(50, 40, 0), (51, 0, 51), (52, 1, 52), (53, 1, 52)} | {(60 + i, 0, 60 + i) for i in range(9)}


def test_blocks_without_near_pairs_get_no_vectors(spark):
    """The exact products are those of pairs that may reach the threshold: few where there are no near vectors."""
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 64))
    x[7] = x[8] + 0.01 * x[9]
    planes, low, step, total = embedding_dedup.rounded(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes, factors = embedding_dedup.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
    upper = embedding_dedup.estimate(codes, factors, planes, low, step, total, 64) + embedding_dedup.slack(factors, 64, 0.93, step=step)
    maybe = np.triu((upper >= 0.93) | (upper.T >= 0.93), 1)
    assert maybe[7, 8] and maybe.sum() < 0.01 * 300 * 300


def test_no_embeddings(spark):
    assert embedding_dedup.near_vectors(spark, spark.createDataFrame([], KINDS)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 64))
    y = x + 0.3 * r.standard_normal((400, 64))
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    real = x @ y.T
    total = np.zeros_like(real)
    for seed in range(20):
        codes, factors = embedding_dedup.encode(x, seed)
        planes, *query = embedding_dedup.rounded(y, seed)
        guess = embedding_dedup.estimate(codes, factors, planes, *query, 64)
        total += guess
        assert (np.diag(guess) + np.diag(embedding_dedup.slack(factors, 64, 0.93, step=query[1])) >= np.minimum(np.diag(real), 0.93)).all()
    assert abs((total / 20 - real).mean()) < 0.002 and np.abs(total / 20 - real).max() < 0.15


model = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no vocabulary here")


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.load(sp.MODEL))


def brute_best(codec, pieces, text):
    """The greatest total score over all segmentations, place by place."""
    by = {t: s for t, s, k in pieces if k == "normal"}
    best = [0.0]
    for i in range(1, len(text) + 1):
        options = [best[j] + by[text[j:i]] for j in range(max(0, i - 20), i) if text[j:i] in by]
        if text[i - 1] not in by:
            options.append(best[i - 1] + codec.unknown)
        best.append(max(options))
    return best[-1]


def total(codec, pieces, text, ids):
    score, i = 0.0, 0
    kinds = [p[2] for p in pieces]
    while i < len(ids):
        if kinds[ids[i]] == "byte":
            b = pieces[ids[i]][0]
            first = int(b[3:5], 16)
            i += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            score += codec.unknown
        else:
            score += pieces[ids[i]][1]
            i += 1
    return score


@model
def test_viterbi_finds_the_best_segmentation(codec, rows):
    pieces = sp.load(sp.MODEL)
    r = random.Random(3)
    words = {w for _, t, *_ in rows for w in (t or "").split(" ")} | {"".join(r.choice("abcdeté☃𝄞 ") for _ in range(12)) for _ in range(60)}
    for w in sorted(words):
        text = sp.SPACE + w.replace(" ", sp.SPACE)
        ids = codec.viterbi(text)
        assert total(codec, pieces, text, ids) == brute_best(codec, pieces, text), w


@model
def test_like_the_library_with_these_pieces_as_unigrams(codec):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(sp.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ("The hello worthless", "été ☃ 日本語 𝄞 x\nnew", "thinnti onder und die Straße", "mentpa, éréoi!"):
        data = np.frombuffer(text.encode(), np.uint8)
        assert codec.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text)


@model
def test_encode_and_decode(spark, docs, rows, codec):
    got = sp.encode(spark, docs)
    assert got.where("not round_trip").count() == 0
    by_text = {}
    for _, t, *_ in rows:
        if t:
            by_text[t] = codec.viterbi(sp.SPACE + t.replace(" ", sp.SPACE))
    want = sorted(str((d, by_text[t] if t else [] if t == "" else None)) for d, t, *_ in rows)
    assert sorted(str((r.doc_id, list(r.ids) if r.ids is not None else None)) for r in got.collect()) == want
    back = sp.decode(spark, got)
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str((d, t)) for d, t, *_ in rows)


@model
def test_nothing_to_encode(spark, none):
    assert sp.encode(spark, none).collect() == [] == sp.decode(spark, sp.encode(spark, none)).collect()


def test_texts_that_collide_in_plain_rolling_hashes_have_their_own_ids(spark):
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    texts = ["".join(letters[x] for x in t[:n]) for n in (1024, 4096) for letters in ("ab", "ba")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = sp.encode(spark, docs).collect()
    assert all(r.round_trip for r in rows) and len({tuple(r.ids) for r in rows}) == 4
    assert [r.text for r in sp.decode(spark, sp.encode(spark, docs)).orderBy("doc_id").collect()] == texts


def test_a_codec_belongs_to_its_whole_vocabulary():
    class Shared:
        def __init__(self, value):
            self.value = value

    one, two = [("a", -1.0, "normal"), ("b", -2.0, "normal"), ("z", -3.0, "normal")], [("a", -1.0, "normal"), ("c", -2.0, "normal"), ("z", -3.0, "normal")]
    assert sp._codec(Shared(one)).viterbi("b") == [1]
    assert sp._codec(Shared(two)).viterbi("c") == [1]
