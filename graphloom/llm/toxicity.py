"""Toxicity: a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

The kernel of two words counts the subsequences of three letters that they share, each occurrence weighted by
decay ** (letters it spans), gaps included, spans of at most SPAN; it is normalised to 1 for equal words. So a word with
inserted or left-out characters stays near its original: characters other than letters and digits match nothing, but
count as gaps. A document is its words (lower case), long ones in overlapping parts, and runs of single letters
("s p a c e d") put together.

Labels are of documents, and an insult is a word or two among hundreds. So training is by multiple instances. Seeds come
first: candidate words (more frequent in toxic than in clean documents of the sample) are compared by the kernel with all
words of the sample, and one after another the candidate is taken that tells most toxic documents from clean ones, those
that a seed explains already counting half each time: so the many words of one document, or of its near copies, do not
crowd out the insults. Then words like a seed are the witnesses of toxic documents, the most toxic words of clean ones
their counterexamples, and the machine and its choice of witnesses are fitted in turn; the round of least loss is kept.
Words are mapped to their kernels with landmark words (the seeds, further candidates, and others), whitened by the
landmarks' own kernel matrix, and a linear machine is trained there. Because the kernel is an inner product of subsequence
counts, the fitted machine is one table of weights by subsequence, and scoring a word is a sum over its own subsequences.
A document's score is the logistic calibration of its three most toxic words and the logarithm of its number of words: of
many words, some look like insults by chance.

The machine is fitted on at most `sample` labelled documents of each class, by hash order; everything is scored. Null and
empty texts have no words and get the score of a text of clean words. Without labels of both classes every score is 0.
Letters other than a-z fold into 27 classes, by code point. Repeated rows count as often as they stand. Other columns are
never read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textarrays as ta
from graphloom.llm.common import written

LETTERS, DECAY, SPAN, LONGEST, STEP = 64, 0.7, 10, 24, 12
SAMPLE, LANDMARKS, ROUNDS, HARD, TOPS = 2000, 300, 3, 12, 3
#: Candidates for seeds, kernels from which a word counts as like a seed, seeds at most, what is left of a document that one explains.
CANDIDATES, LIKE, SEEDS, EXPLAINED = 400, (0.5, 0.6, 0.7, 0.8, 0.95), 40, 0.5
#: Value of a word that a text lacks: that of a clean one.
LACKS = -1.0
CACHE = 400_000
MOD, HELD = 4, 2
_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j < k of all subsequences of words of n characters (3 rows), and their weights."""
    if n not in _triples:
        at = np.array([(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)], np.int64).reshape(-1, 3).T
        _triples[n] = at, DECAY ** (at[2] - at[0] + 1).astype(np.float64)
    return _triples[n]


def letter(c: str) -> int:
    """0 for what isn't a letter or digit; others fold into 1 .. LETTERS - 1, a-z and 0-9 without sharing."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if "0" <= c <= "9":
        return ord(c) - 48 + 27
    return 37 + ord(c) % (LETTERS - 37) if c.isalnum() else 0


class _Letters(dict):
    def __missing__(self, c: str) -> int:
        self[c] = letter(c)
        return self[c]


_letters = _Letters()


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequence ids and weights of words of one length (rows), and the words' norms; unmatched ones weigh 0."""
    at, weight = triples(codes.shape[1])
    a, b, c = codes[:, at[0]], codes[:, at[1]], codes[:, at[2]]
    key = (a * LETTERS + b) * LETTERS + c
    w = np.where((a > 0) & (b > 0) & (c > 0), weight, 0.0)
    order = np.argsort(key, axis=1)
    k, v = np.take_along_axis(key, order, 1), np.take_along_axis(w, order, 1)
    total = np.cumsum(v, axis=1)
    last = np.ones(k.shape, bool)
    last[:, :-1] = k[:, 1:] != k[:, :-1]
    row, col = np.nonzero(last)
    upto = total[row, col]
    before = np.concatenate([[0.0], upto[:-1]])
    before[np.concatenate([[True], row[1:] != row[:-1]])] = 0
    norm = np.sqrt(np.bincount(row, (upto - before) ** 2, minlength=len(codes)))
    return key, w, norm


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and letter codes of words of equal length, in batches of bounded size."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size[size >= 3]):
        at = np.flatnonzero(size == n)
        room = max(1, (1 << 20) // max(1, triples(int(n))[0].shape[1]))
        for lo in range(0, len(at), room):
            part = at[lo : lo + room]
            yield part, np.array([[_letters[c] for c in words[i]] for i in part], np.int64)


def values(words: list[str], table: np.ndarray) -> np.ndarray:
    """The table's inner product with each word's normalised features; 0 for words without any."""
    out = np.zeros(len(words))
    for at, codes in by_length(words):
        key, w, norm = features(codes)
        out[at] = (table[key] * w).sum(axis=1) / np.where(norm > 0, norm, 1)
    return out


def kernels(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels of words (rows) and landmarks."""
    found = [(i, k, v / (n or 1)) for at, codes in by_length(landmarks) for i, k, v, n in zip(at, *features(codes), strict=True)]
    held = np.unique(np.concatenate([k for _, k, _ in found])) if found else np.zeros(0, np.int64)
    place = np.zeros(LETTERS**3, np.int32)  # of the landmarks' own subsequences; the others share row 0, which stays empty
    place[held] = np.arange(1, len(held) + 1)
    dense = np.zeros((len(held) + 1, len(landmarks)), np.float32)
    for i, k, v in found:
        np.add.at(dense[:, i], place[k], v)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at, codes in by_length(words):
        room = max(1, (4 << 20) // max(1, len(landmarks) * triples(codes.shape[1])[0].shape[1]))
        for lo in range(0, len(at), room):
            key, w, norm = features(codes[lo : lo + room])
            own = (w / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
            out[at[lo : lo + room]] = np.matmul(own[:, None, :], dense[place[key]])[:, 0, :]
    return out


def parts(word: str) -> list[str]:
    """A word of up to LONGEST characters as it is, a longer one in overlapping parts."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


def _slice_words(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a slice of lower-case texts, and row and index of each word of each row."""
    start, end, rows = ta.words(data, off)
    _, one, which = np.unique(ta.exact_ids(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
    # runs of single letters, as one word
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    short = upto[end] - upto[start] == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], short.astype(np.int8), [0]])))
    more_row, more = [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for r in np.unique(row[a:b]) if b - a >= 3 else ():
            inside = np.arange(a, b)[row[a:b] == r]
            if len(inside) >= 3:
                more_row.append(r)
                more.append(b"".join(raw[start[i] : end[i]] for i in inside))
    if more:
        words += more
        which = np.concatenate([which, np.arange(len(words) - len(more), len(words))])
        row = np.concatenate([row, more_row])
    return words, row, which


class Scorer:
    """Values of words under a table, or by the seeds, and the part of each that has it; kept for words seen lately."""

    def __init__(self, table: np.ndarray | None, bias: float, seeds: list[tuple[str, float]]):
        self.table, self.bias, self.seeds, self.known = table, bias, seeds, {}

    def value(self, parts_: list[str]) -> np.ndarray:
        if self.table is not None:
            return values(parts_, self.table) + self.bias
        k, least = kernels(parts_, [w for w, _ in self.seeds]), np.array([t for _, t in self.seeds], np.float32)
        return np.where(k >= least, k, k / 2 - 1).max(axis=1).astype(float)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = words
            pieces = [parts(w.decode("utf-8", "replace")) for w in new]
            flat, at = self.value([p for ps in pieces for p in ps]), 0
            for w, ps in zip(new, pieces, strict=True):
                best = int(flat[at : at + len(ps)].argmax()) if len(ps) > 1 else 0
                self.known[w] = (float(flat[at + best]), ps[best])
                at += len(ps)
        return np.array([self.known[w][0] for w in words])

    def part(self, word: bytes) -> str:
        return self.known[word][1]


_scorers: dict[bytes, Scorer] = {}


def _scorer(shared) -> Scorer:
    name, *rest = shared.value
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*rest)
    return _scorers[name]


def _shared(spark: SparkSession, table: np.ndarray | None, bias: float = 0.0, seeds: list[tuple[str, float]] | None = None):
    name = hashlib.sha256((table.tobytes() if table is not None else b"") + repr((bias, seeds)).encode()).digest()
    return spark.sparkContext.broadcast((name, table, bias, seeds))  # LETTERS ** 3 numbers, or SEEDS words


def _best(docs: DataFrame, shared, keep: list[str], hard: int = 0) -> DataFrame:
    """docs' columns to keep, tops (the TOPS greatest values of distinct words, and how many there are), and with hard its
    so many greatest words, each by the part that has its value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, most = _scorer(shared), max(TOPS, hard)
        for batch in batches:
            for lo, hi, data, off in ta.slices(batch.column(len(keep))):
                words, row, which = _slice_words(data, off)
                tops = np.full((hi - lo, TOPS + 1), LACKS)
                tops[:, TOPS] = 0
                lists: list[list[str]] = [[] for _ in range(hi - lo)]
                if words:
                    value = scorer.of(words)
                    pair = np.unique(row.astype(np.int64) * len(words) + which)
                    row, which = pair // len(words), pair % len(words)
                    order = np.lexsort((which, -value[which], row))
                    row, which = row[order], which[order]
                    first = np.searchsorted(row, np.arange(hi - lo + 1))
                    tops[:, TOPS] = np.diff(first)
                    place = np.arange(len(row)) - first[row]
                    for i in np.flatnonzero(place < most).tolist():
                        if place[i] < TOPS:
                            tops[row[i], place[i]] = value[which[i]]
                        if place[i] < hard:
                            lists[row[i]].append(scorer.part(words[which[i]]))
                cols = [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.FixedSizeListArray.from_arrays(pa.array(tops.ravel()), TOPS + 1).cast(pa.list_(pa.float64()))]
                cols += [pa.array(lists, pa.list_(pa.string()))] if hard else []
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "tops", "words"][: len(cols)])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.lower("text").alias("text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "tops array<double>"] + ["words array<string>"] * bool(hard)))


def likeness(train: DataFrame, words: list[str], keep: list[str]) -> DataFrame:
    """train's columns to keep, like: the greatest kernel of each of the words with any word of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in ta.slices(batch.column(len(keep))):
                found, row, which = _slice_words(data, off)
                like = np.zeros((hi - lo, len(words)), np.float32)
                if found:
                    pieces = [parts(w.decode("utf-8", "replace")) for w in found]
                    first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
                    best = np.maximum.reduceat(kernels([p for ps in pieces for p in ps], words), first, axis=0)
                    for r, w in zip(row.tolist(), which.tolist(), strict=True):
                        np.maximum(like[r], best[w], out=like[r])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), pa.FixedSizeListArray.from_arrays(pa.array(like.ravel()), len(words)).cast(pa.list_(pa.float32()))], names=[*keep, "like"])

    kinds = dict(train.dtypes)
    return train.select(*keep, F.lower("text").alias("text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "like array<float>"]))


def seeds_of(like: np.ndarray, toxic: np.ndarray) -> list[tuple[int, float]]:
    """Columns of like (documents by candidates) and the kernels from which they count, one after another the one that tells
    most toxic documents from clean ones; documents that it explains count less for the next."""
    left, (clean, bad) = toxic.astype(float), ((toxic == 0).sum(), (toxic == 1).sum())
    out: list[tuple[int, float]] = []
    while len(out) < SEEDS:
        top = (2 * math.log(3), -1, 0.0)  # two documents' worth of thrice the odds
        for least in LIKE:
            near = like >= least
            hit, missed = near[toxic == 1].sum(axis=0), near[toxic == 0].sum(axis=0)
            gain = np.where(hit > 1, (near * left[:, None]).sum(axis=0) * np.log((hit + 0.5) / (bad + 1) * (clean + 1) / (missed + 0.5)), -1)
            gain[[c for c, _ in out]] = -1
            c = int(gain.argmax())
            if gain[c] > top[0] + 1e-9:
                top = (float(gain[c]), c, least)
        if top[1] < 0:
            break
        out.append(top[1:])
        left[like[:, top[1]] >= top[2]] *= EXPLAINED
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 3.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Primal squared-hinge machine by Newton steps on the examples inside the margin."""
    n, m = x.shape
    z = np.concatenate([x, np.ones((n, 1))], axis=1)
    w = np.zeros(m + 1)
    ridge = np.concatenate([np.ones(m), [1e-3]])
    for _ in range(rounds):
        near = y * (z @ w) < 1
        a, c = z[near], cost * weight[near]
        new = np.linalg.solve(np.diag(ridge) + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[near])
        if np.abs(new - w).max() < 1e-8:
            break
        w = w + (new - w) * (1.0 if _ < 20 else 0.5)
    return w[:-1], float(w[-1])


def candidate_words(train: DataFrame, many: int, others: int) -> tuple[list[str], list[str]]:
    """Words that toxic documents of the sample hold more often than clean ones, each text once; others by hash."""
    seen = train.dropDuplicates(["toxic", "text"]).select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("word"))
    seen = seen.where((F.char_length("word") >= 3) & (F.char_length("word") <= LONGEST))
    table = seen.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    sizes = train.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("clean"))
    table = table.crossJoin(F.broadcast(sizes))  # of one row
    gain = F.col("p") * F.log((F.col("p") + 0.5) / (F.col("bad") + 1) * (F.col("clean") + 1) / (F.col("q") + 0.5))
    best = table.where("p > 0").orderBy(gain.desc(), "word").limit(many).collect()
    rest = table.where("q > 0").orderBy(F.xxhash64("word"), "word").limit(others).collect()
    return [r["word"] for r in best], [r["word"] for r in rest]


def calibration(tops: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of the TOPS values and of the logarithm of 1 + the number of words, and the shift; by Newton's method on
    goals that are short of 0 and 1 by the classes' sizes. Loss of the classes, each counting as one, is returned too."""
    x = np.concatenate([tops[:, :TOPS], np.log1p(tops[:, TOPS:])], axis=1)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    many = np.array([(toxic == c).sum() for c in (0, 1)], float)
    goal = np.where(toxic > 0, (many[1] + 1) / (many[1] + 2), 1 / (many[0] + 2))
    w, hold = np.zeros(z.shape[1]), np.array([ridge] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(hold), z.T @ (p - goal) + hold * w)
        w -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-10:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    loss = float(sum(-np.log(p if c else 1 - p)[toxic == c].mean() for c in (0, 1)))
    weights = w[:-1] / spread
    return np.append(weights, w[-1] - float(weights @ mean)), loss


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Weights by subsequence, the machine's bias, and the calibration; None if a class has no labelled documents.

    labels: doc_id, toxic. Documents whose crc32(doc_id) is HELD modulo MOD are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % MOD != HELD)
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = F.broadcast(written(spark, chosen))  # at most 2 * sample rows
    train = written(spark, docs.select("doc_id", "text").join(ids, "doc_id").where(F.col("text").isNotNull()))
    if {r["toxic"] for r in train.select("toxic").distinct().collect()} != {0, 1}:
        return None
    words, others = candidate_words(train, CANDIDATES, landmarks // 2)
    if not words:
        return None
    # what comes to the driver: for each of 2 * sample documents CANDIDATES numbers, then HARD words in each round
    like = sorted((r["doc_id"], r["toxic"], r["like"]) for r in likeness(train, words, ["doc_id", "toxic"]).collect())
    seeds = [(words[c], least) for c, least in seeds_of(np.array([x for *_, x in like]), np.array([t for _, t, _ in like]))] or [(words[0], LIKE[-1])]
    marks = list(dict.fromkeys([*(w for w, _ in seeds), *words[: landmarks // 2], *others]))[:landmarks]
    own = kernels(marks, marks).astype(np.float64)
    eig, vec = np.linalg.eigh((own + own.T) / 2)
    good = eig > 1e-4 * eig.max()
    white = vec[:, good] / np.sqrt(eig[good])
    rows = []  # each landmark's features, to turn a machine into a table of weights
    for at, codes in by_length(marks):
        key, w, norm = features(codes)
        rows += [(i, k, v / (n or 1)) for i, k, v, n in zip(at, key, w, norm, strict=True)]

    def tabled(alpha: np.ndarray) -> np.ndarray:
        table = np.zeros(LETTERS**3)
        for i, k, v in rows:
            np.add.at(table, k, alpha[i] * v)
        return table

    shared, best, clean = _shared(spark, None, 0.0, seeds), None, Counter(others)
    for turn in range(rounds + 1):
        seen = sorted((r["doc_id"], r["toxic"], r["tops"], r["words"]) for r in _best(train, shared, ["doc_id", "toxic"], HARD).collect())
        toxic = np.array([t for _, t, *_ in seen])
        if turn:
            weights, loss = calibration(np.array([x for _, _, x, _ in seen]), toxic)
            if best is None or loss < best[0]:
                best = (loss, table, bias, weights)
        if turn == rounds:
            break
        scorer = Scorer(*shared.value[1:])
        bad: Counter = Counter()
        more: Counter = Counter()
        for _, t, _, top in seen:
            if t:
                value = scorer.value(top) if top else []
                bad.update(w for w, v in zip(top, value, strict=True) if v > 0)
            else:
                more.update(dict.fromkeys(top, 1))
        if not bad:
            bad.update(top[0] for _, t, _, top in seen if t and top)
        clean |= more
        against = [w for w in sorted(clean) if clean[w] * 8 > bad[w]]
        x = kernels([*(found := sorted(bad)), *against], marks).astype(np.float64) @ white
        y = np.concatenate([np.ones(len(found)), -np.ones(len(against))])
        weight = np.sqrt([*(bad[w] for w in found), *(clean[w] for w in against)])
        if len(against) and len(found):
            weight[y > 0] *= 0.1 * weight[y < 0].sum() / weight[y > 0].sum()
        w, bias = linear_machine(x, y, weight)
        table = tabled(white @ w)
        shared = _shared(spark, table, bias)
    return best[1:]


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % MOD == HELD, F.lit(False))
    fitted = fit(spark, docs, labels, **options)
    if fitted is None:
        return docs.select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    table, bias, weights = fitted
    found = _best(docs.select("doc_id", "text"), _shared(spark, table, bias), ["doc_id"])
    terms = [F.lit(float(w)) * F.col("tops")[i] for i, w in enumerate(weights[:TOPS])]
    none = F.col("tops")[TOPS] == 0  # the score of a clean word
    length = F.lit(float(weights[TOPS])) * F.log1p(F.when(none, F.lit(math.e - 1)).otherwise(F.col("tops")[TOPS]))
    value = 1 / (1 + F.exp(-(sum(terms, length) + F.lit(float(weights[-1])))))
    return found.select("doc_id", held.alias("held_out"), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
