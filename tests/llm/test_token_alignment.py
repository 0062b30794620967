"""Alignment against whole texts tokenized by the libraries, and links found token by token."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from graphloom.llm import queries, token_alignment
from graphloom.llm.common import table

FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
PARTS = ["a", "The", "é", "é", "'s", " ", "  ", "   ", "\n", "\n ", " \n", "\t", " ", "  ", "　", " ", "1", "23", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "日本", "x" * 20, "##", "\x1c", "\x00", "▁", "🙂", "the", "ing", "."]


@pytest.fixture(scope="module")
def libraries():
    a, b = Tokenizer.from_file(token_alignment.BYTE_MODEL), SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    a.encode_special_tokens = True
    return a, b


def brute(libraries, texts):
    """Of each text, in turn: figures and groups."""
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    made = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            made.append(([], [], [], ""))
            continue
        links, groups, i, j, at, to = [], [([], [])], 0, 0, 0, 0
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            at_, to_ = at + len(bytes_a[i]), to + len(bytes_b[j])
            if at_ <= to_:
                groups[-1][0].append(ids_a[i])
                i, at = i + 1, at_
            if to_ <= at_:
                groups[-1][1].append(ids_b[j])
                j, to = j + 1, to_
            if at == to and i < len(ids_a):
                groups.append(([], []))
        made.append((ids_a, ids_b, links, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)))
    count = Counter(x for _, _, links, _ in made for x in set(links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(len(x), len(y), groups.count(";") + bool(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), groups) for x, y, links, groups in made]


def test_intervals():
    ends, a, b = token_alignment.intervals(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert (ends.tolist(), a.tolist(), b.tolist()) == ([2, 3, 5, 6, 9], [0, 1, 1, 2, 2], [0, 0, 1, 2, 3])


@pytest.mark.parametrize("limit", [token_alignment.LIMIT, 40, 1])
def test_tables(spark, libraries, docs, rows, none, limit):
    got = token_alignment.align(spark, docs, limit=limit).collect()
    want = brute(libraries, [t for _, t, *_ in rows])
    assert Counter(str((r.doc_id, *(r[c] for c in (*FIGURES, "groups")))) for r in got) == Counter(str((i, *w)) for (i, *_), w in zip(rows, want, strict=True))
    assert token_alignment.align(spark, none, limit=limit).collect() == []


@pytest.mark.parametrize("cache", [200_000, 50])
def test_random_texts(spark, libraries, monkeypatch, cache):
    r = random.Random(13)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    tokenizers = token_alignment.Tokenizers(open(token_alignment.BYTE_MODEL, encoding="utf-8").read(), open(token_alignment.PIECE_MODEL, "rb").read())
    monkeypatch.setattr(token_alignment, "CACHE", cache)
    aligner, low = token_alignment.Aligner(tokenizers), (1 << 40) - 1
    want = brute(libraries, texts)
    for lo in range(0, len(texts), 100):
        for text, chunks, (n_a, n_b, n_groups, n_links, _, _, groups) in zip(texts[lo:], aligner.of([t.encode() for t in texts[lo : lo + 100]]), want[lo:], strict=False):
            if token_alignment.UNSOUND in chunks or not chunks:
                assert not n_a, text
                continue
            n = sum(c[0] for c in chunks)
            assert (n & low, n >> 40 & low, n >> 80, sum(len(c[2]) // 4 for c in chunks), "".join(c[1] for c in chunks)[:-1]) == (n_a, n_b, n_groups, n_links, groups), text


def test_hot_pairs_and_gathering(spark, libraries, monkeypatch):
    """Nearly all links are one pair; tasks hand on what they have counted when it is much."""
    monkeypatch.setattr(token_alignment, "GATHERED", 30)
    texts = ["the the the"] * 300 + ["the cat", "", None, "unrelatedly strange words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for limit in (token_alignment.LIMIT, 4):
        got = sorted((r.doc_id, *(r[c] for c in (*FIGURES, "groups"))) for r in token_alignment.align(spark, docs, limit=limit).collect())
        assert got == [(i, *w) for i, w in enumerate(brute(libraries, texts))]


def test_products(spark, libraries):
    docs = spark.createDataFrame([(1, "Donaudampfschiff and strange-words", 0), (2, None, 0)], "doc_id long, text string, `group` int")
    aligned = token_alignment.align(spark, docs)
    want = []
    for place, part in enumerate(aligned.where("doc_id = 1").first().groups.split(";")):
        a, b = (x.split(",") for x in part.split("|"))
        want += [(1, place, int(x), int(y)) for x in a for y in b]
    assert sorted((r.doc_id, r.group, r.a, r.b) for r in token_alignment.products(aligned).collect()) == sorted(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query_over_all_documents(spark, libraries):
    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = [str((r.doc_id, *w[:-1], sha(w[-1]))) for r, w in zip(rows, brute(libraries, [r.text for r in rows]), strict=True)]
    got = queries.QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(str((r.doc_id, *(r[c] for c in (*FIGURES, "groups_sha256")))) for r in got) == sorted(want)
