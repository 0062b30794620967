import hashlib
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from graphloom.llm import line_dedup

KINDS = "doc_id long, text string, line string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows):
    order, gone = [], {}
    for doc_id, text in sorted({(d, t) for d, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        for pos, line in enumerate(text.split("\n")):
            if not line.encode().split():
                continue
            bad = False
            for other in order:
                if line == other or (abs(len(line) - len(other)) <= 1 and distance(line, other) <= 1):
                    bad = True
                    break
            order.append(line)
            gone[doc_id, text, pos] = bad
    out = []
    for d, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(lines) if not gone.get((d, t, i))]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def digest(df):
    return Counter((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())


def edited(r, line):
    p = r.randrange(len(line) + 1)
    return r.choice([line[:p] + r.choice("abé") + line[p:], line[:p] + line[p + 1 :], line[:p] + "z" + line[p + 1 :]])


@pytest.fixture(scope="module")
def line_rows():
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(r.choice([1, 2, 3, 7, 15, 16, 17, 40, 63, 64, 65, 130]))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [r.choice(base) for _ in range(r.randint(0, 5))]
        lines = [edited(r, x) if r.random() < 0.5 else x for x in lines]
        lines = [edited(r, x) if r.random() < 0.2 else x for x in lines]
        rows.append((i, "\n".join([*lines, *r.choice([[], ["", "  "], ["All rights reserved by us."], ["the end", "the end"]])]), "clash"))
    return [*rows, (100, None, None), (101, "", ""), (102, "\n\n", ""), rows[3], (None, base[4], "x"), (None, None, None)]


def test_against_brute_force(spark, line_rows):
    docs = spark.createDataFrame(line_rows, KINDS).repartition(3)
    for block, hot in ((8, 1), (64, None)):
        assert digest(line_dedup.drop_lines(spark, docs, block=block, hot=hot)) == brute(line_rows)


def test_short_lines(spark):
    rows = [(1, "Copyright 2021\na\nab\nxyz\nlines of twelve", ""), (2, "Copyright 2022\nb\nb\nwxyz\nxz\nq r s\nlines of eleven", ""), (3, "Copyright 2023!\nabcd\nqrs", "")]
    got = line_dedup.drop_lines(spark, spark.createDataFrame(rows, KINDS))
    assert digest(got) == brute(rows)
    assert [r.n_removed for r in got.orderBy("doc_id").collect()] == [1, 5, 0]


def test_clashing_names(spark):
    rows = [(1, "one line\nanother", 1, 2, 3, 4, 5), (2, "one line\nthird", 6, 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did int, rk int, gone int, left int, h1 int")
    got = line_dedup.drop_lines(spark, docs, counts=False)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], (2, "third", *rows[1][2:])]


def test_corpus_and_sql(spark, docs, line_rows):
    distinct = [x for x in line_rows[:-3] if x[0] not in (3,)]
    got = line_dedup.drop_lines(spark, spark.createDataFrame(distinct, KINDS))
    documents = pd.DataFrame([x[:2] for x in distinct], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    with duckdb.connect() as c:
        c.register("documents", documents)
        want = Counter(c.sql(line_dedup.oracle()).fetchall())
    assert digest(got) == want == brute(distinct)
    out = line_dedup.drop_lines(spark, docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()


def test_long_line(spark):
    r = random.Random(6)
    line = "".join(r.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, line, ""), (2, line[:20_000] + "X" + line[20_000:], ""), (3, line[:9] + "Y" + line[9:-3], "")]
    got = line_dedup.drop_lines(spark, spark.createDataFrame(rows, KINDS)).orderBy("doc_id").collect()
    assert [x.n_removed for x in got] == [0, 1, 0]


def test_empty(spark, none):
    assert line_dedup.drop_lines(spark, none).collect() == []


def test_only_hot_lines_are_broadcast(spark, line_rows, monkeypatch):
    plans, write = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda spark, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(spark, df))[1])
    line_dedup.removed_lines(spark, spark.createDataFrame(line_rows, KINDS))
    joins = [x for plan in plans for x in plan.split("Initial Plan")[0].split("\n") if "BroadcastHashJoin" in x]
    assert len(joins) == 2 and all("LeftOuter" in x for x in joins)  # hot lines meet places and what goes
