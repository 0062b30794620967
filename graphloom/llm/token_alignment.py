"""Alignment of two tokenizers over the same texts, by elementary intervals.

The ends of both tokenizations cut a text into elementary intervals (`union1d`); `searchsorted` names the token of either
side that owns each, so every interval is one overlap of two tokens, a link, and every link is one interval. Ends that
both share close groups. `products` expands groups to all pairs of their tokens. A link's count is the number of documents
that hold its pair of ids linked, over all documents.

Both tokenizers read the text behind a space. Neither has a token that reaches from a word into what follows it (a space or
another character of ASCII that is no letter), so texts are cut there: each distinct chunk is tokenized and aligned once for
a while, in a bounded cache, and no link or group crosses a cut. Texts are tokenized once; a table keeps each document's
figures and links while counts are summed, within tasks first. At most `limit` pairs are handed to all tasks, those with the
greatest counts; beyond `limit` pairs the rest is joined by pair, and none of it is hot.

Texts that are null or empty, or that either tokenizer does not spell byte for byte (one that holds U+2581 itself), have no
tokens: zeros, and an empty string of groups. Long texts are aligned whole. Rows are documents of their own, repeated ones
too, and count as such. An empty table gives an empty one; other columns do not matter.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe_codec import SPACES, Recent, sized
from graphloom.llm.common import unused, written
from graphloom.llm.textarrays import ragged

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 100_000
LONG = 64
#: Pairs whose counts every task may hold: 16 bytes each.
LIMIT = 1 << 21
#: Distinct pairs that a task gathers before it hands on what it has counted.
GATHERED = 1 << 20
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_OTHER = rb"(?:[^ A-Za-z\xc3]|\xc3[\x97\xb7])"
#: Spaces, other characters, letters: up to the next spaces, or a character of ASCII behind letters. Runs of mixed white space are not cut.
CHUNK = re.compile(rb" *(?:" + _OTHER + rb"*" + _LETTER + rb"++(?=[\x80-\xff])|" + _OTHER + rb"*(?:" + SPACES + rb") +)*" + _OTHER + rb"*" + _LETTER + rb"*")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the elementary intervals of two rows of ascending ends, and the places in either row that own each."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Tokenizers:
    """Ids of chunks by both tokenizers, and the bytes that each id spells."""

    def __init__(self, byte_model: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(byte_model), SentencePieceProcessor(model_proto=piece_model)
        self.a.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level symbols show as themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        vocab = json.loads(byte_model)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(map(byte.get, token))
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(len(self.b))]
        crossing = [x for x in self.bytes_b if re.search(_LETTER + rb"[\x00-@\[-`{-\x7f]", x)]
        if crossing:
            raise ValueError(f"pieces that reach beyond a word are not supported, as {crossing[0]!r}")
        self.size_a, self.size_b = (np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        self.space, self.letter = self.b.piece_to_id("▁"), self.b.piece_to_id("▁a")

    def by_a(self, chunks: list[bytes], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and how many each has. Chunks that may stand side by side are read together."""
        joint = np.array([c[:1] == b" " and c[-1:] > b" " and c[-1:] < b"\x80" for c in chunks])
        counts, flat = np.zeros(len(chunks), np.int64), []
        together, alone = np.flatnonzero(joint), np.flatnonzero(~joint)
        parts = [together[lo : lo + 1000].tolist() for lo in range(0, len(together), 1000)]
        for part, e in zip(parts, self.a.encode_batch_fast(["".join([texts[i] for i in part]) for part in parts], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.int64))
            ends = np.searchsorted(np.cumsum(self.size_a[flat[-1]]), np.cumsum([len(chunks[i]) for i in part])) + 1
            counts[part] = np.diff(ends, prepend=0)
        for i, e in zip(alone.tolist(), self.a.encode_batch_fast([texts[i] for i in alone.tolist()], add_special_tokens=False), strict=True):
            flat.append(np.array(e.ids, np.int64))
            counts[i] = len(flat[-1])
        # from the order of reading to that of the chunks
        order = np.concatenate([together, alone])
        start = np.zeros(len(chunks), np.int64)
        start[order] = np.concatenate([[0], np.cumsum(counts[order])[:-1]])
        return np.concatenate(flat)[ragged(start, counts)], counts

    def by_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same. The library puts a space in front of a text that is not empty; chunks without one follow a letter."""
        found = self.b.encode([t[1:] if t[0] == " " else "a" + t for t in texts], num_threads=1)
        found = [(x or [self.space]) if t[0] == " " else x[1:] for t, x in zip(texts, found, strict=True)]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(counts.sum())), counts


class Aligner:
    """Chunks' figures: n_a, n_b and n_groups in 40 bits each, the groups, each with a semicolon behind it, and the links,
    packed pairs. None for chunks that a tokenizer does not spell."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers, self.cache = tokenizers, Recent(CACHE)
        self.wide = len(tokenizers.size_b)
        self.kind = np.uint32 if self.wide * len(tokenizers.size_a) <= 1 << 32 else np.uint64
        self.name = [f"{i}{mark}" for i in range(max(self.wide, len(tokenizers.size_a))) for mark in ",|;"]

    def of(self, texts: list[bytes]) -> list[list[tuple | None]]:
        """Figures of the chunks of each text."""
        parts = [[c for c in CHUNK.findall(b" " + t) if c] if t else [] for t in texts]
        young = self.cache.young.get
        found = [[young(c) for c in p] for p in parts]
        # zero: not known
        new = {c for p, f in zip(parts, found, strict=True) if None in f for c, x in zip(p, f, strict=True) if x is None}
        have = {c: x for c in new if (x := self.cache.get(c)) is not None}
        rest = [c for c in new if c not in have]
        have.update(zip(rest, self._figures(rest), strict=True))
        for c in rest:
            if len(c) <= LONG:
                self.cache.put(c, have[c])
        return [[x if x is not None else have[c] for c, x in zip(p, f, strict=True)] if None in f else f for p, f in zip(parts, found, strict=True)]

    def _figures(self, chunks: list[bytes]) -> list[tuple]:
        if not chunks:
            return []
        t, texts = self.tokenizers, [c.decode() for c in chunks]
        (ids_a, n_a), (ids_b, n_b) = t.by_a(chunks, texts), t.by_b(texts)
        sound = np.ones(len(chunks), bool)
        for ids, n, names in ((ids_a, n_a, t.bytes_a), (ids_b, n_b, t.bytes_b)):
            spelled = [names[i] for i in ids.tolist()]
            if b"".join(spelled) != b"".join(chunks):
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                sound &= [b"".join(spelled[at[i] : at[i + 1]]) == c for i, c in enumerate(chunks)]
        if not sound.all():
            kept = np.flatnonzero(sound).tolist()
            out = [UNSOUND] * len(chunks)
            for i, x in zip(kept, self._figures([chunks[i] for i in kept]), strict=True):
                out[i] = x
            return out
        ends_a, ends_b = np.cumsum(t.size_a[ids_a]), np.cumsum(t.size_b[ids_b])
        ends, own_a, own_b = intervals(ends_a, ends_b)
        links = (ids_a[own_a] * self.wide + ids_b[own_b]).astype(self.kind)
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        # tokens in order of group and side, each with what stands behind it
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        mark_a, mark_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
        names = np.concatenate([ids_a * 3 + mark_a, ids_b * 3 + mark_b * 2])[order].tolist()
        names = [self.name[i] for i in names]
        done = np.cumsum([len(c) for c in chunks])
        n_groups = np.diff(np.searchsorted(shared, done, side="right"), prepend=0)
        link_at = (np.searchsorted(ends, done, side="right") * links.itemsize).tolist()
        packed, out, at, first = links.tobytes(), [], 0, 0
        for a, b, g, last in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), link_at, strict=True):
            out.append((a | b << 40 | g << 80, "".join(names[at : at + a + b]), packed[first:last]))
            at, first = at + a + b, last
        return out


#: Of chunks that a tokenizer does not spell.
UNSOUND = (0, "", b"")
_ready: dict[tuple, Aligner] = {}


def _aligner(files) -> Aligner:
    """One aligner a worker and pair of files."""
    if files.value not in _ready:
        _ready.clear()
        _ready[files.value] = Aligner(Tokenizers(*files.value))
    return _ready[files.value]


def aligned(spark: SparkSession, docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, n_a, n_b, n_groups, n_links, groups, and the distinct links: pairs (a * pieces + b, ascending) and
    how often each occurs, as packed little-endian integers of 4 bytes (8 for large vocabularies; times: always 4)."""
    with open(byte_model, encoding="utf-8") as f, open(piece_model, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # vocabularies: their size does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, low = _aligner(files), (1 << 40) - 1
        for batch in batches:
            for rows, column in sized(batch, batch.column(len(keep)).cast(pa.binary())):
                sums, groups, pairs, times = [], [], [], []
                for chunks in aligner.of([t or b"" for t in column.to_pylist()]):
                    if not chunks or UNSOUND in chunks:
                        chunks = [UNSOUND]
                    numbers, strings, links = zip(*chunks, strict=True)
                    n, links = sum(numbers), np.frombuffer(b"".join(links), aligner.kind)
                    pair, k = np.unique(links, return_counts=True)
                    sums.append((n & low, n >> 40 & low, n >> 80, len(links)))
                    groups.append("".join(strings)[:-1])
                    pairs.append(pair.tobytes())
                    times.append(k.astype(np.uint32).tobytes())
                columns = [*(rows.column(i) for i in range(len(keep))), *(pa.array(x) for x in np.array(sums, np.int64).T), pa.array(groups), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    kinds = dict(docs.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in keep), "n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"]
    return docs.select(*keep, text).mapInArrow(run, ", ".join(schema))


def pair_counts(links: DataFrame, kind: type = np.uint32, gathered: int | None = None) -> DataFrame:
    """pair, n: how many documents hold the pair, from the column pairs of `aligned`."""
    gathered = gathered or GATHERED

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pair, which = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, which, np.concatenate([n for _, n in parts]))
        return pair, total

    def rows(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, column in sized(batch, batch.column(0)):
                parts.append(np.unique(np.frombuffer(b"".join(column.to_pylist()), kind), return_counts=True))
                size += len(parts[-1][0])
                if size > gathered:
                    parts = [merged(parts)]
                    if (size := len(parts[0][0])) > gathered // 2:
                        yield rows(*parts[0])
                        parts, size = [], 0
        if parts:
            yield rows(*merged(parts))

    return links.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(
    spark: SparkSession, docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    limit: int | None = None, shape: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """The columns to keep, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest of their A id),
    count_sum (over links), groups (`a1,a2|b1;a3|b2`: ids in order; shape: what to keep of them). limit: pairs whose counts
    tasks may hold. The columns to keep need names of their own."""
    limit = limit or LIMIT
    tokenizers = Tokenizers(open(byte_model, encoding="utf-8").read(), open(piece_model, "rb").read())
    kind, wide = Aligner(tokenizers).kind, len(tokenizers.size_b)
    own_row, own_rest = unused(docs, "row", "rest")
    docs = aligned(spark, docs, byte_model, piece_model, text, keep).withColumn("groups", shape(F.col("groups")))
    docs = written(spark, docs.withColumn(own_row, F.monotonically_increasing_id()))
    counts = written(spark, pair_counts(docs, kind))
    size, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bar = 0 if size <= limit else total // limit  # fewer than limit pairs have counts above it
    frequent = counts.where(F.col("n") > bar).toArrow().sort_by("pair")  # limit rows of two numbers
    highest = np.zeros(len(tokenizers.size_a), np.int64)
    for a, n in counts.groupBy(F.expr(f"pair div {wide}").alias("a")).agg(F.max("n")).collect():  # a row an id of the vocabulary
        highest[a] = n
    table = spark.sparkContext.broadcast((frequent["pair"].to_numpy(), frequent["n"].to_numpy(), highest))
    figures = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups", own_row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, highest = table.value
        known_pairs, known_counts = np.append(pairs, -1), np.append(counts, 0)
        rest_type = pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64()), ("best", pa.int64())]))
        for batch in batches:
            for rows, column in sized(batch, batch.column(len(figures))):
                pair = np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)
                k = np.frombuffer(b"".join(rows.column(len(figures) + 1).to_pylist()), np.uint32).astype(np.int64)
                at = np.searchsorted(pairs, pair)
                known = known_pairs[at] == pair
                count, best = np.where(known, known_counts[at], 0), highest[pair // wide]
                ends = np.concatenate([[0], np.cumsum([len(x) // kind(0).itemsize for x in column.to_pylist()])])
                of = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]))  # noqa: B023, E731
                out = [*(rows.column(i) for i in range(len(figures))), of(k * (known & (count == best))), of(k * count)]
                if bar:
                    left = np.concatenate([[0], np.cumsum(~known)])[ends]
                    rest = pa.StructArray.from_arrays([pa.array(x[~known]) for x in (pair, k, best)], names=["pair", "k", "best"])
                    out.append(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), rest).cast(rest_type))
                yield pa.RecordBatch.from_arrays(out, names=[*figures, "n_best", "count_sum", *([own_rest] if bar else [])])

    kinds = dict(docs.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in figures), "n_best long, count_sum long", *([f"`{own_rest}` array<struct<pair: long, k: long, best: long>>"] if bar else [])]
    out = docs.select(*figures, "pairs", "times").mapInArrow(run, ", ".join(schema))
    order = [*keep, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if not bar:
        return out.select(*order)
    out = written(spark, out)
    links = out.select(own_row, F.inline(own_rest))
    more = links.join(counts.where(F.col("n") <= bar), "pair")
    more = more.groupBy(own_row).agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("k")).otherwise(0)).alias("best_"), F.sum(F.col("k") * F.col("n")).alias("sum_"))
    out = out.drop(own_rest).join(more, own_row, "left")
    more = {"n_best": F.col("n_best") + F.coalesce("best_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_", F.lit(0))}
    return out.select(*(more.get(c, F.col(c)).alias(c) for c in order))


def products(aligned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, group (place in the text), a, b: all pairs of the tokens of each group."""
    parts = aligned.where("groups <> ''").select(*keep, F.posexplode(F.split("groups", ";")).alias("group", "part"))
    side = lambda i: F.explode(F.split(F.element_at(F.split("part", r"\|"), i), ",").cast("array<int>"))
    return parts.withColumn("a", side(1)).withColumn("b", side(2)).drop("part")
