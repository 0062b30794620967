"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest

from graphloom.llm import spelling


def variants(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return abs(len(a) - len(b)) == 1 and min(a, b, key=len) in variants(max(a, b, key=len))


def brute(n, times=spelling.TIMES):
    """(word, form, root, n, n_near, form_n) of each word of a count."""
    form, out = {}, []
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        top = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = (top if top and n[top] >= times * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n[w], form[w][1], n.get(f)))
    return sorted(out, key=str)


def words_of(rows, shortest, often, every):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= shortest and n >= often}


def frame(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_random_words(spark, block):
    r = random.Random(block)
    n = {}
    for _ in range(60):
        base = "".join(r.choice("abcé") for _ in range(r.randint(2, 9)))
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                i = r.randrange(len(w))
                w[i : i + r.randint(0, 1)] = r.choice(["", "a", "b", "ü", "ac"])
            if len(w) > 1:
                n["".join(w)] = r.choice([2, 3, 30, 31, 300, 3000])
    n = {w: k for w, k in n.items() if len(w) > 1}
    assert rows_of(spelling.group(spark, frame(spark, n), block=block)) == brute(n)


def test_one_ending_and_one_beginning_for_all(spark):
    """Every word shares half of itself with every other; letters of one place, and insertions there."""
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0xE0, 0xF7)]
    words = [f"start{a}ending" for a in letters] + [f"start{a}{b}ending" for a in "abc" for b in letters] + [f"{a}{b}xxstatement" for a in letters[:9] for b in letters[:9]] + ["startending"]
    n = {w: 2 + i % 7 * 11 for i, w in enumerate(dict.fromkeys(words))}
    assert rows_of(spelling.group(spark, frame(spark, n), block=3)) == brute(n)
    assert spelling.blocks(spark, frame(spark, n), 3).groupBy("key").count().where("count > 200").isEmpty()


def test_chains_ties_and_long_words(spark):
    long_ = "ab" * 3000
    n = {"colored": 2, "coloured": 25, "colourred": 260, "colouurred": 3000, "colouuurred": 300000, "tiesbba": 100, "tiesbab": 100, "tiesbaa": 9, "alonealone": 5, long_: 2, long_[:99] + long_[100:]: 20, long_[::-1]: 7}
    got = rows_of(spelling.group(spark, frame(spark, n)))
    assert got == brute(n)
    by = {r[0]: r for r in got}
    assert by["colored"][2] == "colouuurred" and by["tiesbaa"][1] == "tiesbab"


@pytest.mark.parametrize("every", [1, 3, 31])
def test_words_of_documents(spark, docs, rows, none, every):
    extra = [(i, "Straße naïve NAÏVE ×÷ paragraphs Paragraphs.paragraph's " * 3, None, None, None, None, None, None) for i in range(500, 520)]
    extra.append((600, "longletters" * 5000, None, None, None, None, None, None))
    all_ = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = words_of([(i, t) for i, t, *_ in [*rows, *extra]], 5, 2, every)
    got = spelling.extract(all_, shortest=5, every=every)
    assert {r.word: r.n for r in got.collect()} == want
    assert rows_of(spelling.group(spark, got)) == brute(want)
    assert spelling.group(spark, spelling.extract(none)).collect() == []
