import hashlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import suffix
from graphloom.llm.substring_dedup import dedup_byte_strings, dedup_word_windows


def brute(rows, length, split):
    units = [split((t or "").encode()) for _, t, *_ in rows]
    seen = Counter(bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for (doc_id, *_), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[bytes(u[i : i + length]) if isinstance(u, bytes) else tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(u), sum(gone), spans, hashlib.sha256(bytes(kept) if isinstance(u, bytes) else b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{"shard": 1}, {}, {"most": 0, "hot": 2}, {"most": 2, "hot": 1}])
def test_words(spark, docs, rows, options):
    got = dedup_word_windows(spark, docs, **options).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, len(r.removed), r.kept_sha256) for r in got) == brute(rows, 35, bytes.split)


@pytest.mark.parametrize("options", [{"shard": 1}, {}, {"most": 0, "hot": 2}, {"most": 2, "hot": 1}])
def test_bytes(spark, docs, rows, options):
    got = dedup_byte_strings(spark, docs, texts=True, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 200, bytes)
    assert all(hashlib.sha256(r.text).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark, none):
    assert dedup_word_windows(spark, none).collect() == [] == dedup_byte_strings(spark, none).collect()


def test_nothing_goes_that_the_index_has_not_found(spark, docs, monkeypatch):
    from graphloom.llm import substring_dedup

    nothing = lambda symbols, off, length, asked: np.zeros(int(np.maximum(0, np.diff(off) - length + 1)[asked].sum()), bool)
    monkeypatch.setattr(substring_dedup, "repeats_by_index", nothing)
    monkeypatch.setattr(substring_dedup, "repeats_by_suffixes", nothing)
    assert dedup_word_windows(spark, docs).where("n_removed > 0").isEmpty()
    assert dedup_byte_strings(spark, docs).where("n_removed > 0").isEmpty()


def thue_morse(n):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t[:n]), "".join("ba"[x] for x in t[:n])


@pytest.mark.parametrize("n", [1024, 4096])
def test_strings_that_collide_in_plain_rolling_hashes(spark, n):
    a, b = thue_morse(n)
    rows = [(0, a), (1, b), (2, " ".join(a)), (3, " ".join(b)), (4, f"{a} " * 40), (5, f"{b} " * 20 + f"{a} " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_word_windows(spark, docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, len(r.removed), r.kept_sha256) for r in got) == brute(rows, 35, bytes.split)
    got = dedup_byte_strings(spark, docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 200, bytes)


def test_suffix_array():
    r = np.random.default_rng(3)
    for _ in range(100):
        t = r.integers(1, r.integers(2, 6), r.integers(1, 80))
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_indexes_agree_with_brute_force():
    r = np.random.default_rng(4)
    for _ in range(100):
        off = np.concatenate([[0], np.cumsum(r.integers(1, 50, r.integers(1, 8)))])
        symbols, length = r.integers(0, 3, off[-1]).astype(np.uint8), int(r.integers(2, 14))
        windows = [tuple(symbols[s : s + length]) for a, b in zip(off[:-1], off[1:], strict=True) for s in range(a, b - length + 1)]
        seen = Counter(windows)
        want = [seen[w] > 1 for w in windows]
        assert suffix.repeats_by_suffixes(symbols, off, length).tolist() == want
        assert suffix.repeats_by_index(symbols.astype(np.uint64), off, length).tolist() == want
