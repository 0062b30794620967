"""Where long strings repeat: content-defined segments bring equal windows together.

A window is L consecutive symbols (words or bytes) of one document. Each window is dealt by its anchor, the smallest
hashed k-gram in it: equal windows have equal anchors, wherever they stand. Consecutive windows with one anchor form a
segment, so a corpus of n symbols gives about 2n / (L - k + 2) segments instead of n windows, and only anchors that
occur twice can hold a repeated window. Equal segments are one kind (by the content's hash of 62 bits, of which the anchor follows): the
kind's first place and, if it has more, its last one as a witness go to the caller's index, which alone decides what is
repeated. What it says of a kind holds for every place of the kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textarrays as ta
from graphloom.llm.common import bounded, row_key, written

#: Positions in a slice fit in so many bits beside the hash that orders anchors.
INDEX_BITS = 24
CHUNK = 1 << 16
OCCURRENCE = "did long, rk long, starts binary, times int, first long, last long, n_windows int, mh long, ch long"
#: Of a kind (mh, ch), the symbols of one of its places; report: the place that the index answers for, not the witness.
CONTENT = "mh long, ch long, n_windows int, report boolean, anchor int, symbols binary"
#: A piece of a kind (pmh, pch), from its window `off` on.
PIECE = CONTENT + ", pmh long, pch long, off int"
VERDICT = "mh long, ch long, ranges binary"
#: Kinds of one anchor that are indexed together; more are dealt anew, by longer and longer strings of their windows.
MOST = 1024
RANGES = "did long, rk long, ranges binary"
#: Keys with more than a 2000th of all places, at most 2000 keys, are salted.
HOT = 2000


def symbols_of(unit: str, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a slice and the offset of each row's first."""
    if unit == "byte":
        return ta.byte_symbols(data), off
    start, end, rows = ta.words(data, off)
    return ta.word_hashes(data, start, end), rows


def cut(symbols: np.ndarray, rows: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start in its row, windows, anchor's and content's hash of each segment of a slice."""
    w = length - k + 1
    n = len(symbols)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for base in range(0, max(0, n - length + 1), CHUNK):
        part = symbols[base : base + CHUNK + length - 1]
        roll = ta.Rolling(part)
        gram = ta.mix(roll.grams(k))
        key = (gram >> ta.U64(INDEX_BITS) << ta.U64(INDEX_BITS)) | np.arange(len(gram), dtype=ta.U64)
        anchor = (ta.sliding_min(key, w) & ta.U64((1 << INDEX_BITS) - 1)).astype(np.int64)
        row = owner[base : base + len(anchor)]
        ok = np.arange(base, base + len(anchor)) + length <= rows[row + 1]
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if not len(s):
            continue
        a = anchor[s]
        shift = a - s
        content = roll.of(s, e + length) + (shift * 1_000_003 + (e - s)).astype(ta.U64) * ta.U64(0x2545F4914F6CDD1D)
        yield row[s], base + s - rows[row[s]], e - s + 1, gram[a], ta.mix(content)


def occurrences(docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """The segments of every text: docs has did, rk and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, rk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "rk"))
            for lo, _, data, off in ta.slices(batch.column("text")):
                for row, start, many, mh, ch in cut(*symbols_of(unit, data, off), length, k):
                    # what a document holds again and again, as in "a b a b", is one row
                    order = np.lexsort((start, ch, mh, row))
                    row, start, many, mh, ch = (x[order] for x in (row, start, many, mh, ch))
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (mh[1:] != mh[:-1]) | (ch[1:] != ch[:-1])
                    at = np.flatnonzero(new)
                    ends = np.concatenate([at, [len(row)]])
                    first, last = (pa.array(start[i].astype(np.int64)) for i in (at, ends[1:] - 1))
                    starts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(start.astype(np.int64)))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(did[lo + row[at]]), pa.array(rk[lo + row[at]]), starts, pa.array(np.diff(ends).astype(np.int32)), first, last, pa.array(many[at].astype(np.int32)), pa.array(mh[at].view(np.int64)), pa.array(ch[at].view(np.int64))],
                        names=[c.split()[0] for c in OCCURRENCE.split(", ")],
                    )

    return docs.mapInArrow(run, OCCURRENCE)


def grouped(found: DataFrame) -> DataFrame:
    """By document, its packed ranges (start and end as int64) in one binary list."""
    return found.groupBy("did", "rk").agg(F.collect_list("ranges").alias("ranges"))


def packed(docs: DataFrame) -> DataFrame:
    """docs with text as compressed bytes, for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, off = ta.buffers(batch.column(at))
            view = memoryview(np.ascontiguousarray(data))
            texts = pa.array([press.compress(view[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
            yield batch.set_column(at, "text", texts)

    kinds = ", ".join(f"`{c}` {'binary' if c == 'text' else t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, kinds)


def unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(x) if x is not None else b"" for x in column.to_pylist()]


def ranges_of(lists: list | None) -> np.ndarray:
    """Merged, sorted, disjoint ranges as rows of (start, end)."""
    parts = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in lists or () if x]
    if not parts:
        return np.zeros((0, 2), np.int64)
    r = np.concatenate(parts)
    r = r[np.argsort(r[:, 0], kind="stable")]
    top = np.maximum.accumulate(r[:, 1])
    new = np.ones(len(r), bool)
    new[1:] = r[1:, 0] > top[:-1]
    at = np.flatnonzero(new)
    return np.stack([r[at, 0], np.maximum.reduceat(r[:, 1], at)], axis=1)


def redealt(unit: str, length: int, k: int, room: int) -> Callable:
    """Cuts kinds into pieces of at most `room` windows, by the windows' distance from the anchor, and deals each piece by
    the string that all windows of such distances share: windows that are equal stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if unit == "byte" else np.uint64
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                symbols, m = np.frombuffer(r["symbols"], kind), r["n_windows"]
                roll = ta.Rolling(ta.byte_symbols(symbols) if unit == "byte" else symbols)
                a = r["anchor"]
                if a < 0:
                    grams = ta.mix(roll.grams(k)[m - 1 : length - k + 1]).view(np.int64)
                    a = m - 1 + int(np.flatnonzero(grams == r["mh"])[0])
                for j in range((a - m + 1) // room, a // room + 1):
                    first, last = max(0, a - j * room - room + 1), min(m - 1, a - j * room)
                    shared, own = roll.of(np.array([a - j * room, first]), np.array([a - j * room - room + 1 + length, last + length]))
                    key = ta.mix(np.array([shared, own], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)
                    out.append((int(key[0]), int(key[1]), last - first + 1, r["report"], a - first, symbols[first : last + length].tobytes(), r["mh"], r["ch"], first))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


def with_verdicts(places: DataFrame, by: str, verdicts: DataFrame, sizes: DataFrame, hot: int | None) -> DataFrame:
    """places joined with verdicts by (mh, ch). sizes: places `t` of each key; keys with many are dealt by `by` as well."""
    total = sizes.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]  # one number
    limit = max(1, total // HOT if hot is None else hot)
    heavy = sizes.where(F.col("t") > limit).select("mh", "ch", F.ceil(F.col("t") / limit).cast("int").alias("salts"))
    heavy = F.broadcast(heavy) if total // limit <= HOT else heavy  # fewer than total / limit keys
    salts = F.coalesce("salts", F.lit(1))
    places = places.join(heavy, ["mh", "ch"], "left").withColumn("salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("salts")
    verdicts = verdicts.join(heavy, ["mh", "ch"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return places.join(verdicts, ["mh", "ch", "salt"])


def searched(index: Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray], unit: str, length: int, shard: int) -> Callable:
    """Partitions hold whole anchors, sorted; shards are cut between anchors. Of each kind that the index is to answer for,
    the ranges that its repeated windows cover, from the kind's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if unit == "byte" else np.uint64
        rows: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            parts = [np.frombuffer(r["symbols"], kind) for r in rows]
            off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            asked = np.array([r["report"] for r in rows], bool)
            twice = index(np.concatenate(parts), off, length, asked)
            at, out = 0, []
            for r in rows:
                if not r["report"]:
                    continue
                hit = np.flatnonzero(twice[at : at + r["n_windows"]])
                at += r["n_windows"]
                if len(hit):
                    edge = np.flatnonzero(np.diff(hit) > 1)
                    both = np.stack([hit[np.concatenate([[0], edge + 1])], hit[np.concatenate([edge, [len(hit) - 1]])] + length], axis=1)
                    out.append((r["mh"], r["ch"], both.astype(np.int64).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["mh", "ch", "ranges"])

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                if size >= shard and r["mh"] != last:
                    yield flush()
                    rows, size = [], 0
                rows.append(r)
                size += len(r["symbols"]) // np.dtype(kind).itemsize
                last = r["mh"]
        if rows:
            yield flush()

    return run


def shift(starts: str) -> Callable:
    """Adds the place (or packed places) in column `starts` to each row's ranges: all ranges of all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places, ranges in zip(batch.column(starts).to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                at = np.frombuffer(places, np.int64) if isinstance(places, bytes) else np.array([places])
                out.append((at[:, None] + np.frombuffer(ranges, np.int64)[None, :]).tobytes())
            kept = [c for c in batch.schema.names if c not in (starts, "ranges")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "ranges"])

    return run


def shifted(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ranges of df (keys, starts, ranges)."""
    return df.select(*keys, "starts", "ranges").mapInArrow(shift("starts"), ", ".join([*(f"{c} long" for c in keys), "ranges binary"]))


def verdicts_of(spark: SparkSession, content: DataFrame, unit: str, length: int, k: int, index: Callable, shard: int, most: int, hot: int | None, room: int) -> DataFrame:
    """What the index says of each kind of content. No shard has more than `most` kinds of one anchor: kinds of anchors with
    more are cut into pieces, equal pieces are one kind again with a place and a witness, and so on; what is said of pieces
    goes back to what they were cut from. With one window a piece, a key has one kind."""
    many = written(spark, content.groupBy("mh").agg(F.count("*").alias("n_")).where(F.col("n_") > 2 * most).select("mh"))
    search = searched(index, unit, length, shard)
    if not room or many.isEmpty():
        return content.repartition("mh").sortWithinPartitions("mh").mapInArrow(search, VERDICT)
    cool = content.join(bounded(many), "mh", "left_anti").repartition("mh").sortWithinPartitions("mh").mapInArrow(search, VERDICT)
    pieces = written(spark, content.join(bounded(many), "mh", "left_semi").mapInArrow(redealt(unit, length, k, room), PIECE))
    place = F.struct("pmh", "pch", "off", "report", "n_windows", "anchor", "symbols")
    kinds = written(spark, pieces.groupBy("mh", "ch").agg(F.count("*").alias("t"), F.min(place).alias("a"), F.max(place).alias("b")))
    two = F.explode(F.when(F.col("t") > 1, F.array(F.struct(F.lit(True).alias("report"), F.col("a").alias("of")), F.struct(F.lit(False).alias("report"), F.col("b").alias("of")))).otherwise(F.array(F.struct(F.lit(True).alias("report"), F.col("a").alias("of")))))
    smaller = kinds.select("mh", "ch", two.alias("x")).select("mh", "ch", "x.of.n_windows", "x.report", "x.of.anchor", "x.of.symbols")
    said = verdicts_of(spark, written(spark, smaller), unit, length, k, index, shard, most, hot, 0 if room == 1 else max(1, room // 4))
    asked = pieces.where("report").select("mh", "ch", "pmh", "pch", "off")
    back = with_verdicts(asked, "pch", written(spark, said), kinds.select("mh", "ch", "t"), hot)
    back = shifted(back.select(F.col("pmh").alias("mh"), F.col("pch").alias("ch"), F.col("off").cast("long").alias("starts"), "ranges"), ["mh", "ch"])
    return cool.unionByName(back)


def repeated(
    spark: SparkSession, docs: DataFrame, unit: str, length: int, k: int, index: Callable[[np.ndarray, np.ndarray, int, np.ndarray], np.ndarray], shard: int, most: int = MOST, hot: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ranges of repeated windows by document (did, rk, list of packed ranges), and the documents packed, by key.

    index(symbols, offsets, length, asked) gets the kinds of a shard, whole anchors together, and says for each window of the
    segments asked for (all starts, in order) whether it occurs twice or more in the shard. shard: symbols that a shard holds,
    unless one anchor has more. hot: places of one key beyond which it is salted (default: a 2000th of all).
    """
    keyed = docs.select(*row_key(docs, "doc_id", "text"), "doc_id", "text")
    places = written(spark, occurrences(keyed.select("did", "rk", "text"), unit, length, k))
    # counted within tasks first: neither a kind nor an anchor that very many documents hold is gathered anywhere
    one, other = (f(F.struct("did", "rk", F.col(at).alias("start"))) for f, at in ((F.min, "first"), (F.max, "last")))
    kinds = places.groupBy("mh", "ch").agg(F.sum("times").alias("t"), F.first("n_windows").alias("n_windows"), one.alias("a"), other.alias("b"))
    anchors = places.groupBy("mh").agg(F.sum("times").alias("n_")).where(F.col("n_") > 1).select("mh")
    live = written(spark, kinds.withColumn("b", F.when(F.col("t") > 1, F.col("b"))).join(anchors, "mh", "left_semi"))
    texts = packed(keyed)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The symbols of the places asked for, document by document."""
        width = 1 if unit == "byte" else 8
        for batch in batches:
            asked = batch.column("asked")
            off, each = asked.offsets.to_numpy(), asked.flatten()
            start, m = (each.field(c).to_numpy().astype(np.int64) for c in ("start", "n_windows"))
            lo, hi = (width * start).tolist(), (width * (start + m + length - 1)).tolist()
            symbols: list[bytes] = []
            for raw, i, j in zip(unpacked(batch.column("text")), (off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist(), strict=True):
                if unit != "byte":
                    raw = symbols_of(unit, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes()
                symbols += [raw[p:q] for p, q in zip(lo[i:j], hi[i:j], strict=True)]
            cols = [each.field("mh"), each.field("ch"), each.field("n_windows"), each.field("report"), pa.array(np.full(len(start), -1, np.int32)), pa.array(symbols, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CONTENT.split(", ")])

    two = F.explode(F.array(F.struct(F.lit(True).alias("report"), F.col("a").alias("at")), F.struct(F.lit(False).alias("report"), F.col("b").alias("at"))))
    asked = live.select("mh", "ch", "n_windows", two.alias("x")).where("x.at is not null").select("mh", "ch", "n_windows", "x.report", "x.at.*")
    asked = asked.groupBy("did", "rk").agg(F.collect_list(F.struct("start", "n_windows", "mh", "ch", "report")).alias("asked"))
    content = written(spark, texts.drop("doc_id").join(asked, ["did", "rk"]).mapInArrow(fetch, CONTENT))
    said = written(spark, verdicts_of(spark, content, unit, length, k, index, shard, most, hot, length // 6 + 1))
    found = with_verdicts(places.select("mh", "ch", "did", "rk", "starts"), "did", said, live.select("mh", "ch", "t"), hot)
    return grouped(shifted(found, ["did", "rk"])), texts
