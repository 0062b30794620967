"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Sets that are equal become one. Each set is embedded as minwise tokens,
one for each of `tokens` hash functions, so that two sets share a share of tokens near their Jaccard similarity. A run
splits the collection recursively: at a node each token position is chosen with probability 1 / (similarity * tokens),
by a hash of the node, and sets with the same token there go to the same child. A pair at the threshold is expected in
one child of each node it shares, pairs below die out. Buckets small enough are compared by brute force, large ones at
the last level in blocks. Runs are repeated until a pair at the threshold is met with the target recall.

What the buckets link (by the tokens, with a margin of four standard errors) forms clusters; inside these the whole
shingle sets are compared exactly, in blocks of members against blocks, each pair once. What goes through the blocks is
not the sets but in what each differs from one set of its cluster, so near copies of long texts are a few shingles each.
No pairs are emitted: a block gives counts of links and a spanning forest.

Texts with one to four words have one shingle, all their words. Null texts and texts without words have none: they link
with nothing and are classes of their own. Rows equal in id and text are copies of one another. Empty tables give empty
results. No columns but doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textarrays as ta
from graphloom.llm.blocks import groups, in_blocks, least_labels
from graphloom.llm.common import WORD, bounded, row_key, unused, written
from graphloom.llm.components import components

WORDS, SIMILARITY = 5, 0.8
TOKENS, LEVELS, RECALL = 128, 3, 0.9999
SMALL, BLOCK, EXACT_BLOCK = 64, 2048, 512
#: Members of a cluster that meet one copy of its base.
SPREAD = 1024
_FACTORS = np.random.default_rng(42).integers(1, 1 << 32, (2, TOKENS), dtype=np.uint32)
_FACTORS[0] |= 1


def survival(levels: int) -> float:
    """Probability that a pair at the threshold shares a node after so many levels of one run."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, levels: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(levels)))


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row of a slice, and their offsets."""
    start, end, rows = ta.words(data, off)
    hashes = ta.word_hashes(data, start, end)
    grams, n = ta.mix(ta.grams(hashes, k)), np.diff(rows)
    sets = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(ta.mix(ta.Rolling(hashes[a:b]).of(np.array([0]), np.array([b - a])) + np.uint64(b - a)))
        else:
            sets.append(grams[:0])
    return np.concatenate(sets) if sets else grams[:0], np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64) if len(n) else np.zeros(1, np.int64)


def sketches(elements: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minwise tokens of non-empty sets, a row each."""
    x = (ta.mix(elements) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(off) - 1, TOKENS), np.uint32)
    for i in range(TOKENS):
        out[:, i] = np.minimum.reduceat(x * _FACTORS[0, i] + _FACTORS[1, i], off[:-1])
    return out


def fixed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(matrix)
    size = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * size).astype(np.int32)), pa.py_buffer(raw)])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """did, rk, h1, h2 (hashes of the shingle set; null if it is empty), n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in ta.slices(batch.column("text")):
                elements, at = shingle_sets(data, off, k)
                full = np.flatnonzero(np.diff(at) > 0)
                ids = np.zeros((2, hi - lo), np.uint64)
                marks = np.zeros((hi - lo, 0), np.uint32)
                sketch = pa.nulls(hi - lo, pa.binary())
                if len(full):
                    begin = at[:-1][full]
                    for i, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B)):
                        ids[i, full] = ta.mix(np.add.reduceat(ta.mix(elements ^ np.uint64(salt)), begin) + np.diff(at)[full].astype(np.uint64))
                    marks = sketches(elements, np.concatenate([begin, at[-1:]]))
                    place = np.full(hi - lo, -1)
                    place[full] = np.arange(len(full))
                    sketch = fixed(marks).take(pa.array(place, mask=place < 0))
                empty = np.diff(at) == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("did").slice(lo, hi - lo), batch.column("rk").slice(lo, hi - lo), *(pa.array(x.view(np.int64), mask=empty) for x in ids), pa.array(np.diff(at)), sketch],
                    names=["did", "rk", "h1", "h2", "n_shingles", "sketch"],
                )

    return docs.select(*row_key(docs, "doc_id", "text"), "text").mapInArrow(run, "did long, rk long, h1 long, h2 long, n_shingles long, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    data, off = ta.buffers(column)
    return np.frombuffer(np.ascontiguousarray(data).tobytes(), np.uint32).reshape(len(off) - 1, -1)


def _children(similarity: float) -> Callable:
    """Splits nodes: from (key, set, sketch) to (key, set) of each child."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) / (similarity * TOKENS))))
    salts = ta.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "set"))
            nodes, node = np.unique(key, return_inverse=True)
            chosen = ta.mix(nodes[:, None] + salts[None, :]) < limit
            sketch = _matrix(batch.column("sketch"))
            for i in np.flatnonzero(chosen.any(axis=0)):
                at = np.flatnonzero(chosen[node, i])
                child = ta.mix(ta.mix(key[at] ^ salts[i]) + sketch[at, i].astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[at].view(np.int64))], names=["key", "set"])

    return run


def _roots(runs: int, similarity: float) -> Callable:
    """The children of the root of every run: each set is at all of these roots."""
    split = _children(similarity)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(runs):
                root = np.full(batch.num_rows, int(ta.mix(np.array([r + 1], np.uint64))[0]), np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(root), batch.column("set"), batch.column("sketch")], names=["key", "set", "sketch"])

    return lambda batches: split(every(batches))


def _candidates(least: float) -> Callable:
    """Sets of a bucket, each with the least set that it is linked to through the bucket by its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "task"):
            ids, sketch, side = group.column("set").to_numpy(), _matrix(group.column("sketch")), group.column("side").to_numpy()
            order = np.argsort(ids)
            ids, sketch, side = ids[order], sketch[order], side[order]
            linked = np.zeros((len(ids), len(ids)), bool)
            for i in range(len(ids)):
                linked[i] = ((sketch == sketch[i]).sum(axis=1) >= least * TOKENS) & ((side[i] == 2) | (side != side[i]))
            root = ids[least_labels(linked)]
            at = np.flatnonzero(root != ids)
            yield pa.RecordBatch.from_arrays([pa.array(root[at]), pa.array(ids[at])], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    out = np.zeros((n, n), np.float64)
    if not size.any():
        return out
    owner, every = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column)
    keep = many[column] > 1
    owner, column = owner[keep], column[keep]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for lo in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, (lo, lo + 8192))
            m = np.zeros((n, min(8192, int(column[b - 1]) - lo + 1)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            out += m @ m.T
    out[np.arange(n), np.arange(n)] = size
    return out


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set (elements) what it lacks of its cluster's base and what it has besides."""
    kept = ("set", "cluster", "n", "copies")
    for batch in batches:
        out: list[list] = [[], [], []]
        for x, y in zip(batch.column("elements").to_pylist(), batch.column("base").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out[0].append(len(y))
            out[1].append(np.setdiff1d(y, x, assume_unique=True).tobytes())
            out[2].append(np.setdiff1d(x, y, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary()), strict=True))], names=[*kept, "base", "lacks", "more"])


def _exact(similarity: float) -> Callable:
    """Of each member of a block pair: links (documents linked with) and the least set reached through the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "task"):
            ids, copies, side = (group.column(c).to_numpy() for c in ("set", "copies", "side"))
            _, order = np.unique(ids, return_index=True)  # rows equal in id and text come once each
            ids, copies, side = ids[order], copies[order], side[order]
            base = group.column("base")[0].as_py()  # a task has one cluster's members
            lacks, more = ([np.frombuffer(x[i], np.uint64) for i in order] for x in (group.column("lacks").to_pylist(), group.column("more").to_pylist()))
            n_lacks, n_more = (np.array([len(x) for x in y], np.float64) for y in (lacks, more))
            both, size = base - n_lacks[:, None] - n_lacks[None, :] + overlaps(lacks) + overlaps(more), base - n_lacks + n_more
            linked = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
            linked &= (side[:, None] == 2) | (side[:, None] != side[None, :])
            linked[np.arange(len(ids)), np.arange(len(ids))] = False
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ copies), pa.array(ids[least_labels(linked)])], names=["set", "links", "root"])

    return run


def join(
    spark: SparkSession, docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL, block: int = BLOCK, exact_block: int = EXACT_BLOCK
) -> DataFrame:
    """doc_id, n_shingles, n_links (other documents at least so similar), class_id (least id in reach), kept, rk.

    kept holds for one row of each class; rk tells apart rows with the same id.
    """
    members = written(spark, _sets(docs, words))
    same_set = ["h1", "h2", "n_shingles"]
    sets = members.where("h1 is not null").groupBy(*same_set).agg(F.count("*").alias("copies"), F.min(F.struct("did", "rk")).alias("first"), F.first("sketch").alias("sketch"))
    sets = written(spark, sets.withColumn("set", F.monotonically_increasing_id()))  # as written, ids no longer change
    tokens = sets.select("set", "sketch")
    nodes = tokens.mapInArrow(_roots(runs_for(recall, levels), similarity), "key long, set long")
    tasks = []
    for level in range(1, levels + 1):
        nodes = written(spark, nodes)
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        held = nodes.join(sizes, "key")
        lists = held.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("set")).alias("list")).select("list").distinct()
        tasks.append(lists.select(F.xxhash64("list").alias("task"), F.explode("list").alias("set"), F.lit(2).alias("side")))
        large = held.where(F.col("n") > small)
        if level < levels:
            nodes = large.join(tokens, "set").select("key", "set", "sketch").mapInArrow(_children(similarity), "key long, set long")
        else:
            tasks.append(in_blocks(large, "key", "n", block, "set").select("task", "set", "side"))
    buckets = tasks[0]
    for t in tasks[1:]:
        buckets = buckets.unionByName(t)
    margin = similarity - 4 * math.sqrt(similarity * (1 - similarity) / TOKENS)
    compared = buckets.join(tokens, "set").repartition("task").sortWithinPartitions("task").mapInArrow(_candidates(margin), "a long, b long")
    clusters = components(spark, compared.distinct())
    sized = clusters.withColumnsRenamed({"id": "set", "label": "cluster"})
    sized = sized.join(sized.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    asked = written(spark, sized.join(sets.select("set", "copies", "first"), "set").select("set", "cluster", "n", "copies", F.col("first.did").alias("did_"), F.col("first.rk").alias("rk_")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in ta.slices(batch.column("text")):
                elements, at = shingle_sets(data, off, words)
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(elements))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("set", "cluster", "n", "copies")), raw], names=["set", "cluster", "n", "copies", "elements"])

    texts = docs.select(*row_key(docs, "doc_id", "text"), "text")
    texts = texts.join(bounded(asked, 2), (F.col("did") == F.col("did_")) & (F.col("rk") == F.col("rk_"))).select("set", "cluster", "n", "copies", "text")
    texts = written(spark, texts.mapInArrow(fetch, "set long, cluster long, n long, copies long, elements binary"))
    # a cluster is named by its least set: that is the base, in as many copies as keep its members spread
    spread = F.ceil(F.col("n") / SPREAD).cast("int")
    bases = texts.where("set = cluster").dropDuplicates(["set"]).select("cluster", F.col("elements").alias("base"), F.explode(F.sequence(F.lit(0), spread - 1)).alias("part"))
    apart = texts.withColumn("part", F.pmod(F.xxhash64("set"), spread).cast("int")).join(bases.hint("merge"), ["cluster", "part"])
    apart = written(spark, apart.mapInArrow(_differences, "set long, cluster long, n long, copies long, base long, lacks binary, more binary"))
    exact = in_blocks(apart, "cluster", "n", exact_block, "set").select("task", "set", "copies", "side", "base", "lacks", "more")
    exact = written(spark, exact.repartition("task").sortWithinPartitions("task").mapInArrow(_exact(similarity), "set long, links long, root long"))
    links = exact.groupBy("set").agg(F.sum("links").alias("links"))
    classes = components(spark, exact.where("links > 0").select(F.col("root").alias("a"), F.col("set").alias("b")).distinct()).withColumnsRenamed({"id": "set"})
    of_set = sets.select("set", "copies", "first").join(links, "set", "left").join(classes, "set", "left")
    of_set = of_set.withColumn("label", F.coalesce("label", "set"))
    least = of_set.groupBy("label").agg(F.min("first").alias("least"))
    of_set = of_set.join(least, "label").select("set", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    of_set = of_set.join(sets.select("set", *(F.col(c).alias(f"{c}_") for c in same_set)), "set")
    out = members.select("did", "rk", *same_set).join(of_set, [F.col(c) == F.col(f"{c}_") for c in same_set], "left")
    me = F.struct("did", "rk")
    least = F.coalesce("least", me)
    no_id = F.lit(-(2**63))
    real = lambda c: F.when(c == no_id, None).otherwise(c)
    return out.select(
        real(F.col("did")).alias("doc_id"), "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), real(least["did"]).alias("class_id"), (least == me).alias("kept"), "rk"
    )


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: the least id; rows that are equal in id and text count once."""
    did_, rk_, did, rk = unused(docs, "did_", "rk_", "did", "rk")
    rows = written(spark, join(spark, docs, **options).select(F.coalesce("doc_id", F.lit(-(2**63))).alias(did_), F.col("rk").alias(rk_), "kept"))
    twice = written(spark, rows.where("kept").groupBy(did_, rk_).agg(F.count("*").alias("n")).where("n > 1").select(did_, rk_))
    gone = written(spark, rows.where("not kept").select(did_, rk_).distinct().unionByName(twice))
    keyed = docs.withColumns(dict(zip((did, rk), row_key(docs, "doc_id", "text"), strict=True)))
    same = (F.col(did) == F.col(did_)) & (F.col(rk) == F.col(rk_))
    out = keyed.join(bounded(gone, 1), same, "left_anti")
    if not twice.isEmpty():
        out = out.unionByName(keyed.join(bounded(twice, 1), same, "left_semi").dropDuplicates([did, rk]))
    return out.select(*docs.columns)


def oracle(words: int = WORDS, similarity: float = SIMILARITY) -> str:
    """The join of all documents that share a shingle, as DuckDB SQL, for distinct ids: doc_id, n_shingles, n_links, class_id, kept."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {words - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM d)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {words - 1}),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE k >= {similarity} * (x.n + y.n - k) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
counts AS (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(n_links, 0)::BIGINT AS n_links, class_id, doc_id = class_id AS kept FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN counts USING (doc_id) JOIN classes USING (doc_id)"""
