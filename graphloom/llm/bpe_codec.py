"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix of a word has one last token, whatever follows is encoded apart from it. So the word is read once:
a suffix automaton of the vocabulary names, longest first, the tokens that end at each place, and the one that may stand
behind the last token of the prefix before it is stored. Two tokens may stand side by side if undoing their merges, latest
first, never shows a pair at the seam that would have been merged earlier. Following the stored tokens back gives the exact
ids that merging by rank gives, in time linear in the word.

Normalising and splitting into words is done as the file says, by the library's own parts, one chunk between spaces at a
time; each distinct chunk is encoded once for a while, in a bounded cache. The special tokens of the file are found in the
text as it stands, as the library finds them. Decoding joins tokens as the library does for the file's decoder.

Null texts have null ids, empty ones and those of white space alone none. Long texts are encoded whole, in pieces between
spaces. Rows, repeated ones too, are independent; other columns do not matter. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

MODEL = "/opt/tokenizers/word_bpe_49k.json"
CACHE = 400_000
LONG = 64
PIECE = 1 << 20
BATCH = 2 << 20
#: What may end a run of white space that a space goes on with: ASCII, and the other spaces in UTF-8.
SPACES = rb"[\t-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: Chunks that begin with spaces (the first may not): byte-level splitting depends on nothing beyond them.
SPACED = re.compile(rb"(?:^(?! )| +)(?:[^ ]*(?:" + SPACES + rb") +)*[^ ]*")

WHITE_SPACE = re.compile(rb"[ \t-\r]")


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merging by rank, the leftmost of the least first, as BPE is defined."""
    while len(symbols) > 1:
        rank, i = min((ranks.get(pair, len(ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
        if rank == len(ranks):
            break
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]
    return symbols


def load(path: str) -> dict:
    """What workers need of a tokenizer file: its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    model, normal, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
    drops = split["type"] == "Sequence" and [(x["type"], x.get("behavior"), x.get("invert")) for x in split["pretokenizers"]] == [("Split", "Removed", True), ("ByteLevel", None, None)]
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or not (drops or split["type"] == "ByteLevel" and normal is None and not split["add_prefix_space"]):
        raise ValueError(f"{path}: only byte-level BPE that splits at white space is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: special tokens must be found as they stand")
    if spec["decoder"] and spec["decoder"]["type"] != "ByteLevel":
        raise ValueError(f"{path}: decoder {spec['decoder']['type']} is not supported")
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {a + b: i for i, (a, b) in enumerate(merges)}
    if len(made) < len(merges) or any(made.get(x, -1) >= i for i, pair in enumerate(merges) for x in pair):
        raise ValueError(f"{path}: each token needs one merge, of tokens made before")
    spelled = {t: [t] for t in vocab if t not in made}
    for a, b in merges:
        spelled[a + b] = spelled[a] + spelled[b]
    ranks = {pair: i for i, pair in enumerate(merges)}
    # a token that merging its own symbols does not give is in no encoding
    tokens = [t for t, s in spelled.items() if t in vocab and (len(s) == 1 or merged(s, ranks) == [t])]
    symbols = {t: i for i, t in enumerate(t for t in spelled if t not in made)}
    graph = _automaton([[symbols[x] for x in spelled[t]] for t in tokens])
    token = np.full(len(graph["length"]), -1, np.int32)
    token[graph.pop("ends")] = [vocab[t] for t in tokens]
    pairs = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int32)
    names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"spec": text, "symbols": symbols, "end": end, "token": token, "pairs": pairs, "names": [names.get(i, "") for i in range(max(names) + 1)], "special": special, "drops": drops, "bytes": bool(spec["decoder"]), **graph}


def _automaton(strings: list[list[int]]) -> dict:
    """The suffix automaton of all strings: steps as (state << 10 | symbol, state), suffix links, lengths, and each string's state."""
    go: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], []

    def state(size: int, steps: dict[int, int]) -> int:
        go.append(steps)
        link.append(0)
        length.append(size)
        return len(go) - 1

    def split(p: int, c: int, q: int) -> int:
        """A state of its own for the strings of q that end behind p."""
        own = state(length[p] + 1, dict(go[q]))
        link[own], link[q] = link[q], own
        while p >= 0 and go[p].get(c) == q:
            go[p][c] = own
            p = link[p]
        return own

    for string in strings:
        last = 0
        for c in string:
            if (q := go[last].get(c)) is not None:
                last = q if length[q] == length[last] + 1 else split(last, c, q)
                continue
            new, p = state(length[last] + 1, {}), last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            last = new
        ends.append(last)
    steps = [(s << 10 | c, to) for s, out in enumerate(go) for c, to in out.items()]
    return {"steps": np.array(steps, np.int64).reshape(-1, 2), "link": np.array(link, np.int32), "length": np.array(length, np.int32), "ends": np.array(ends, np.int64)}


class Recent:
    """A cache of at most 2 * limit entries that keeps what is still asked for."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    def __init__(self, table: dict):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(table["spec"])
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.symbols, self.end, self.names, self.drops, self.special = table["symbols"], table["end"], table["names"], table["drops"], table["special"]
        self.go = dict(zip(*table["steps"].T.tolist(), strict=True))
        self.link, self.length, self.token = table["link"].tolist(), table["length"].tolist(), table["token"].tolist()
        # of each state, the longest token among its proper suffixes
        self.out = [0] * len(self.link)
        for s in np.argsort(table["length"], kind="stable").tolist()[1:]:
            up = self.link[s]
            self.out[s] = up if self.token[up] >= 0 else self.out[up]
        self.rank = {(a, b): i for i, (a, b, _) in enumerate(table["pairs"].tolist())}
        self.made, self.left, self.right, self.size = ([x] * len(self.names) for x in (-1, 0, 0, 0))
        for i, (a, b, t) in enumerate(table["pairs"].tolist()):
            self.made[t], self.left[t], self.right[t] = i, a, b
        for s, t in enumerate(self.token):
            if t >= 0:
                self.size[t] = self.length[s]
        self.found = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.joint = "" if table["bytes"] else " "
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level symbols show as themselves
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.spelled = [bytes(map(byte.get, t)) if table["bytes"] and t not in self.special else t.encode() for t in self.names]
        self.beside: dict[int, bool] = {}
        self.chunks, self.recent = Recent(CACHE), Recent(CACHE)

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay side by side when what they spell together is merged."""
        key = a << 32 | b
        rank, made = self.rank, self.made
        bound = len(rank)
        while True:
            if rank.get((a, b), bound) < bound:
                fits = False
                break
            # the later merge is undone first; of two equal ones the right one, which was made later
            if made[a] > made[b]:
                bound, a = made[a], self.right[a]
            elif made[b] >= 0:
                bound, b = made[b] + 1, self.left[b]
            else:
                fits = True
                break
        if len(self.beside) >= CACHE:
            self.beside.clear()
        self.beside[key] = fits
        return fits

    def words(self, texts: list[str]) -> list[list[int]]:
        """Ids of words of byte-level symbols. In ascending order, each goes on from the prefix it shares with the one before."""
        go, link, length, token, out, beside, size, symbols = self.go, self.link, self.length, self.token, self.out, self.beside, self.size, self.symbols
        prior, found = "", []
        last: list[int] = []  # token of each prefix's encoding
        states: list[tuple[int, int]] = []
        for text in texts:
            k, most = 0, min(len(text), len(prior)) - 1  # last symbols are of a kind of their own
            while k < most and text[k] == prior[k]:
                k += 1
            del last[k:], states[k:]
            state, have = states[-1] if k else (0, 0)
            i, prior = k, text
            for c in [*[symbols[c] for c in text[k:-1]], symbols[text[-1] + self.end]]:
                i += 1
                while (to := go.get(state << 10 | c)) is None:
                    state = link[state]
                    have = length[state]
                state, have = to, have + 1
                s = state if token[state] >= 0 and have == length[state] else out[state]
                while at := i - length[s]:
                    before, t = last[at - 1], token[s]
                    if (fits := beside.get(before << 32 | t)) is None:
                        fits = self.fits(before, t)
                    if fits:
                        break
                    s = out[s]
                last.append(token[s])
                states.append((state, have))
            ids = []
            while i:
                ids.append(last[i - 1])
                i -= size[last[i - 1]]
            found.append(ids[::-1])
        return found

    def _pieces(self, chunks: list[str]) -> list[list[str]]:
        """Words of byte-level symbols of chunks without special tokens."""
        normal, split = self.normalizer.normalize_str if self.normalizer else str, self.splitter.pre_tokenize_str
        if self.drops:  # read together, with spaces between
            text = normal(" ".join(chunks))
            sizes = [len(x) for x in text.split(" ")]
            if len(sizes) == len(chunks):
                out, i, end = [[] for _ in chunks], -1, 0
                for piece, (start, _) in split(text):
                    while start >= end:
                        i += 1
                        end += sizes[i] + 1
                    out[i].append(piece)
                return out
        return [[piece for piece, _ in split(normal(c))] for c in chunks]

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct chunks, as the bytes of 32-bit integers."""
        known, new = {}, []
        for c in chunks:
            if (x := self.chunks.get(c)) is not None:
                known[c] = x
            else:
                new.append(c)
        for lo in range(0, len(new), 1000):
            part = new[lo : lo + 1000]
            texts = b"\n".join(part).decode().split("\n") if self.drops else [c.decode() for c in part]  # chunks hold no white space where it is dropped
            if self.found and any(self.found.search(t) for t in texts):
                split = [[x for x in self.found.split(t) if x] for t in texts]
                plain = self._pieces([x for p in split for x in p if x not in self.special])
                of = iter(plain)
                ids = self._ids(plain)
                found = [b"".join([self.special[x].to_bytes(4, "little") if x in self.special else b"".join([ids[w] for w in next(of)]) for x in p]) for p in split]
            else:
                plain = self._pieces(texts)
                ids = self._ids(plain)
                found = [ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for p in plain]
            for c, x in zip(part, found, strict=True):
                known[c] = x
                if len(c) <= LONG:
                    self.chunks.put(c, x)
        return known

    def _ids(self, pieces: list[list[str]]) -> dict[str, bytes]:
        """Packed ids of all words of pieces."""
        have, rest = {}, []
        for w in {w for p in pieces for w in p}:
            if (x := self.recent.get(w)) is not None:
                have[w] = x
            else:
                rest.append(w)
        rest.sort()
        for w, ids in zip(rest, self.words(rest), strict=True):
            have[w] = packed = struct.pack(f"<{len(ids)}i", *ids)
            if len(w) <= LONG:
                self.recent.put(w, packed)
        return have

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, packed; long texts in pieces."""
        return [x for lo, hi in runs([len(t) for t in texts], PIECE) for x in (self._joined([self._chunks(t) for t in texts[lo:hi]]) if hi - lo > 1 else [self._long(texts[lo])])]

    def _chunks(self, text: bytes) -> list[bytes]:
        return text.split() if self.drops else [c for c in SPACED.findall(text) if c]

    def _long(self, text: bytes) -> bytes:
        if not self.drops:
            return self._joined([self._chunks(text)])[0]
        out, lo = [], 0
        while lo < len(text):
            cut = WHITE_SPACE.search(text, lo + PIECE)  # a piece ends at white space
            hi = cut.start() if cut else len(text)
            out.append(self._joined([self._chunks(text[lo:hi])])[0])
            lo = hi
        return b"".join(out)

    def _joined(self, parts: list[list[bytes]]) -> list[bytes]:
        young = self.chunks.young.get
        found = [[young(c) for c in p] for p in parts]
        known = self.learn(list({c for p, f in zip(parts, found, strict=True) if None in f for c, x in zip(p, f, strict=True) if x is None}))
        return [b"".join([x if x is not None else known[c] for c, x in zip(p, f, strict=True)] if None in f else f) for p, f in zip(parts, found, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text that the library's decoder makes of ids."""
        spelled = self.spelled
        out = self.joint.encode().join([spelled[i] for i in ids.tolist()])
        return out if self.joint else out.decode("utf-8", "replace").encode()


_codecs: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec a worker and file: it is built and its cache filled once."""
    table = shared.value
    if table["spec"] not in _codecs:
        _codecs.clear()
        _codecs[table["spec"]] = Codec(table)
    return _codecs[table["spec"]]


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """First and last + 1 of runs of items that have limit together, or are one."""
    at, lo = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


def sized(batch: pa.RecordBatch, column: pa.Array, limit: int = BATCH) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows whose values have limit bytes or so together."""
    for lo, hi in runs(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), limit):
        yield batch.slice(lo, hi - lo), column.slice(lo, hi - lo)


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False, decoded: bool = False) -> DataFrame:
    """The columns to keep, ids (array<int>; packed: binary, little-endian 32-bit integers), n_tokens; with decoded=True
    also what the ids decode to, by the same workers."""
    shared = spark.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for rows, column in sized(batch, batch.column(len(keep)).cast(pa.binary())):
                texts = column.to_pylist()
                ids = [None if t is None else x for t, x in zip(texts, codec.encode([t or b"" for t in texts]), strict=True)]
                count = np.array([len(x or b"") // 4 for x in ids], np.int64)
                if packed:
                    out = pa.array(ids, pa.binary())
                else:
                    at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), mask=np.array([*(x is None for x in ids), False]))
                    out = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4")))
                more = {"decoded": pa.array((None if x is None else codec.decode(np.frombuffer(x, "<i4")).decode() for x in ids), pa.string())} if decoded else {}
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep))), out, pa.array(count), *more.values()], names=[*keep, "ids", "n_tokens", *more])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"ids {'binary' if packed else 'array<int>'}", "n_tokens long", *["decoded string"] * decoded]))


def decode(spark: SparkSession, encoded: DataFrame, model: str = MODEL, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns to keep, and the text that ids (array<int>, or binary as encode packs them) decode to; null for null."""
    shared = spark.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(len(keep))
            lists = (None if x is None else np.frombuffer(x, "<i4") if isinstance(x, bytes) else np.array(x, np.int32) for x in (v.as_py() for v in column))
            texts = [None if x is None else codec.decode(x).decode() for x in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, text])

    kinds = dict(encoded.dtypes)
    return encoded.select(*keep, ids).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{text}` string"]))
