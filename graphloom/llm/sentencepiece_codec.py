"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The text is escaped as the model says (a space in front, spaces as U+2581) and cut before each run of spaces, which no
piece crosses. Each distinct chunk is encoded once for a while: the automaton reads it character by character, and at
each place its state and the output links from there name all pieces that end there, longest first; each relaxes the
best score of its end by that of its start. Ties go to the longer last piece. A character that no piece covers costs
less than any piece and falls back to its bytes. Decoding joins the pieces' bytes and takes the space in front away.

The segmentation is the one of greatest total score, as unigram models define it. A model whose scores are merge ranks
(BPE) is read the same way: the result is what the library gives for these pieces and scores as a unigram model, not its
merges. Models with a normaliser, and those that drop extra spaces, are refused.

Null texts have null ids, empty ones none. Texts that hold U+2581 themselves decode with spaces there (round_trip false).
Long texts are encoded whole, chunk by chunk. Rows, repeated ones too, are independent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import textarrays as ta

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 300_000
UNKNOWN_PENALTY = 10.0


def load(path: str) -> list[tuple[str, float, str]]:
    """Pieces as (text, score, kind), kind one of normal, byte, other, in the order of their ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n = model.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not n.escape_whitespaces:
        raise ValueError(f"{path}: only models without normalisation, with a space in front, are supported")
    pieces = [(p.piece, p.score, {1: "normal", 4: "normal", 6: "byte"}.get(p.type, "other")) for p in model.pieces]
    crossing = [t for t, _, kind in pieces if kind == "normal" and SPACE in t.lstrip(SPACE)]
    if crossing:
        raise ValueError(f"{path}: pieces with a space after another character are not supported, as {crossing[0]!r}")
    return pieces


class Codec:
    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.next: list[dict[str, int]] = [{}]
        self.piece = [-1]  # that the state spells
        for i, (text, _, kind) in enumerate(pieces):
            if kind != "normal" or not text:
                continue
            state = 0
            for c in text:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                state = self.next[state][c]
            self.piece[state] = i
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            state = queue.popleft()
            for c, child in self.next[state].items():
                queue.append(child)
                f = self.fail[state]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                to = self.next[f].get(c, 0)
                self.fail[child] = to if to != child else 0
            # output link: the longest proper suffix that is a piece
            f = self.fail[state]
            self.link[state] = f if self.piece[f] >= 0 else self.link[f]
        self.size, self.score = [len(p[0]) for p in pieces], [p[1] for p in pieces]
        self.bytes = [0] * 256
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes[int(text[3:5], 16)] = i
        self.unknown = min((s for _, s, k in pieces if k == "normal"), default=0.0) - UNKNOWN_PENALTY
        plain = [bytes([int(t[3:5], 16)]) if k == "byte" else t.replace(SPACE, " ").encode() if k == "normal" else b"" for t, _, k in pieces]
        self.spelled = np.frombuffer(b"".join(plain), np.uint8)
        self.spelled_size = np.array([len(x) for x in plain], np.int64)
        self.spelled_at = np.concatenate([[0], np.cumsum(self.spelled_size)[:-1]])
        self.cache: dict[bytes, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the pieces of escaped text."""
        n = len(text)
        best, last = [0.0] + [None] * n, [-1] * (n + 1)
        go, fail, piece, link, size, score = self.next, self.fail, self.piece, self.link, self.size, self.score
        state = 0
        for i, c in enumerate(text):
            while state and c not in go[state]:
                state = fail[state]
            state = go[state].get(c, 0)
            s = state if piece[state] >= 0 else link[state]
            single = False
            top, end = None, -1
            while s:
                p = piece[s]
                k = size[p]
                single |= k == 1
                value = best[i + 1 - k] + score[p]
                if top is None or value > top:
                    top, end = value, p
                s = link[s]
            if not single and (top is None or best[i] + self.unknown > top):
                top, end = best[i] + self.unknown, -2
            best[i + 1], last[i + 1] = top, end
        out, i = [], n
        while i:
            p = last[i]
            if p == -2:
                out.extend(self.bytes[b] for b in reversed(text[i - 1].encode()))
                i -= 1
            else:
                out.append(p)
                i -= size[p]
        return out[::-1]

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a chunk, as the bytes of 32-bit integers."""
        ids = self.cache.get(raw)
        if ids is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            ids = np.array(self.viterbi(raw.decode("utf-8", "replace").replace(" ", SPACE)), np.int32).tobytes()
            if len(raw) <= 64:
                self.cache[raw] = ids
        return ids

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row of a slice of texts, and their offsets."""
        n = len(off) - 1
        full = np.flatnonzero(np.diff(off) > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        # a space in front of each text
        at = off[:-1][full] + np.arange(len(full))
        text = np.full(len(data) + len(full), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(np.arange(1, len(full) + 1), np.diff(off)[full])] = data
        begin = text == 32
        begin[1:] &= text[:-1] != 32
        begin[at] = True
        start = np.flatnonzero(begin)
        end = np.concatenate([start[1:], [len(text)]])
        _, one, which = np.unique(ta.exact_ids(text, start, end), return_index=True, return_inverse=True)
        raw = text.tobytes()
        found = [self.chunk(raw[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        size = np.array([len(x) // 4 for x in found])
        where = np.concatenate([[0], np.cumsum(size)[:-1]])
        ids = np.frombuffer(b"".join(found), np.int32)[ta.ragged(where[which], size[which])]
        upto = np.concatenate([[0], np.cumsum(size[which])])
        rows = np.zeros(n, np.int64)
        rows[full] = np.diff(np.concatenate([upto[np.searchsorted(start, at)], [upto[-1]]]))
        return ids, np.concatenate([[0], np.cumsum(rows)])

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of rows of ids, and their offsets."""
        size = self.spelled_size[ids]
        data = self.spelled[ta.ragged(self.spelled_at[ids], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[off]
        keep = np.ones(len(data), bool)
        full = np.flatnonzero(np.diff(upto) > 0)
        front = upto[:-1][full]
        front = front[data[front] == 32]
        keep[front] = False
        return data[keep], upto - np.searchsorted(front, upto, side="left")


_codecs: dict[tuple, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker and vocabulary: it is built and its cache filled once."""
    pieces = tuple(shared.value)
    if pieces not in _codecs:
        _codecs.clear()
        _codecs[pieces] = Codec(list(pieces))
    return _codecs[pieces]


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, ids (array<int>), n_tokens, round_trip (decoding gives the text again, byte for byte)."""
    shared = spark.sparkContext.broadcast(load(model))  # a vocabulary: its size does not depend on the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(len(keep))
            for lo, hi, data, off in ta.slices(column):
                ids, at = codec.encode(data, off)
                back, back_off = codec.decode(ids, at)
                same = np.diff(back_off) == np.diff(off)
                if len(back) == len(data) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != data)])[off]
                    same &= np.diff(wrong) == 0
                else:
                    same = np.array([same[i] and back[back_off[i] : back_off[i + 1]].tobytes() == data[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)], bool)
                null = pa.array(np.asarray(column.slice(lo, hi - lo).is_null()))
                offsets = pa.array(at.astype(np.int32), mask=np.concatenate([np.asarray(null), [False]]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), lists, pa.array(np.diff(at)), pa.array(same)], names=[*keep, "ids", "n_tokens", "round_trip"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "n_tokens long", "round_trip boolean"])
    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, model: str = MODEL, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, and text: what the ids spell. Null ids give a null text."""
    shared = spark.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(len(keep))
            size = np.array([len(x) if x is not None else 0 for x in column.to_pylist()], np.int64)
            data, off = codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string(), mask=np.asarray(column.is_null()))], names=[*keep, "text"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*keep, ids).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))
