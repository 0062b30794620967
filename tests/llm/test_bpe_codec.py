"""Encoding and decoding against the tokenizers library, id by id."""

import hashlib
import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe_codec, queries
from graphloom.llm.common import table

FILES = {"word": bpe_codec.MODEL, "byte": "/opt/tokenizers/byte_bpe_50k.json"}
PARTS = ["a", "B", "é", "é", "'s", "'T", " ", "  ", "\n", "\t", " ", "　", " ", "1", "23", "<|endoftext|>", "<|startoftext|>", "̸", "Σ", "İ", "日本", "x" * 20, "ab", "##", "\x1c", "\x00", "</w>", "the", "ing"]


@pytest.fixture(scope="module", params=sorted(FILES))
def both(request):
    path = FILES[request.param]
    return bpe_codec.Codec(bpe_codec.load(path)), Tokenizer.from_file(path)


def test_random_texts(both):
    codec, library = both
    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    for text, ids, want in zip(texts, codec.encode([t.encode() for t in texts]), library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == want.ids, text
        assert codec.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False), text


def test_long_texts(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe_codec, "PIECE", 1000)
    r = random.Random(12)
    for text in ["".join(r.choice(PARTS) for _ in range(20_000)), "é" * 50_000, "ab" * 40_000, "one two " * 20_000]:
        assert np.frombuffer(codec.encode([text.encode()])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_caches(both, monkeypatch):
    codec, library = both
    text = "many different words, each met again: many different words " * 3
    monkeypatch.setattr(codec, "chunks", bpe_codec.Recent(5))
    monkeypatch.setattr(codec, "recent", bpe_codec.Recent(5))
    assert np.frombuffer(codec.encode([text.encode()])[0], "<i4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(len(x.young) <= 5 and len(x.old) <= 5 for x in (codec.chunks, codec.recent))


def test_stored_tokens_are_those_of_every_prefix(both):
    """The last token of each prefix is that of the prefix merged by rank."""
    codec, _ = both
    names = codec.names
    ranks = {(names[a], names[b]): i for (a, b), i in codec.rank.items()}
    for word in ("internationally", "aaaaaaa", "ababababab", "mississippi"):
        for n in range(1, len(word) + 1):
            symbols = [*word[: n - 1], word[n - 1] + codec.end]
            assert [names[i] for i in codec.words([word[:n]])[0]] == bpe_codec.merged(symbols, ranks)


@pytest.mark.parametrize("packed", [False, True])
def test_tables(spark, docs, rows, none, packed):
    library = Tokenizer.from_file(bpe_codec.MODEL)
    coded = bpe_codec.encode(spark, docs, packed=packed)
    got = [(r.doc_id, None if r.ids is None else (np.frombuffer(r.ids, "<i4").tolist() if packed else list(r.ids)), r.n_tokens) for r in coded.collect()]
    ids = lambda t: None if t is None else library.encode(t, add_special_tokens=False).ids
    assert sorted(map(str, got)) == sorted(str((i, ids(t), len(ids(t) or []))) for i, t, *_ in rows)
    back = [(r.doc_id, r.text) for r in bpe_codec.decode(spark, coded).collect()]
    assert sorted(map(str, back)) == sorted(str((i, None if t is None else library.decode(ids(t), skip_special_tokens=False))) for i, t, *_ in rows)
    assert bpe_codec.decode(spark, bpe_codec.encode(spark, none, packed=packed)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_query_over_all_documents(spark):
    library = Tokenizer.from_file(bpe_codec.MODEL)

    def row(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return str((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))

    want = [row(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    got = queries.QUERIES["op11_bpe_codec"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got) == sorted(want)
