"""Quality rules under weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Each rule reads a few counts of a document. The generative model has two hidden classes; given the class, rules vote
independently, each with its own probabilities of good, bad and abstain. Expectation-maximisation fits those and the
share of good documents to the counts of all voting patterns, at most 3 ** rules of them however large the corpus, and a
document's posterior probability of being good decides, not whether it passes every rule.

A null text has no words. Texts without words fail the base rule. Repeated rows count as often as they stand. An empty
table gives an empty result and no model. No columns but doc_id and text are read by `features`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import textarrays as ta
from graphloom.llm.common import WHITE, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_bang", "n_marks", "n_letter_words", "n_symbol_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, LOWER, BANG = (np.zeros(256, bool) for _ in range(3))
UPPER[ord("A") : ord("Z") + 1] = True
LOWER[ord("a") : ord("z") + 1] = True
BANG[ord("!")] = True
LETTER = UPPER | LOWER
LETTER[128:] = True  # bytes of other characters count as letters
MARK = ~(LETTER | WHITE)
MARK[ord("0") : ord("9") + 1] = False
MIN_WORDS, MAX_REPEAT = 50, 0.5


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _distinct(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different ids each row has."""
    both = np.unique(row * (int(ids.max(initial=0)) + 1) + ids)
    return np.bincount(both // (int(ids.max(initial=0)) + 1), minlength=rows)


def counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a slice of texts."""
    n = len(off) - 1
    start, end, rows = ta.words(data, off)
    out = {"n_words": np.diff(rows), "n_symbols": _per_row(SYMBOL[data], off), "n_upper": _per_row(UPPER[data], off), "n_lower": _per_row(LOWER[data], off), "n_bang": _per_row(BANG[data], off)}
    out["word_chars"] = _per_row(~WHITE[data] & ((data & 0xC0) != 0x80), off)
    out["n_marks"] = _per_row(MARK[data], off)
    for name, kind in (("n_letter_words", LETTER), ("n_symbol_words", SYMBOL)):
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        out[name] = _per_row(total[end] > total[start], rows)
    ids = ta.exact_ids(data, start, end)
    row = np.repeat(np.arange(n), np.diff(rows))
    out["n_distinct"] = _distinct(ids, row, n)
    at = np.arange(max(0, len(ids) - 2))
    at = at[at + 3 <= rows[row[at] + 1]]
    _, same, many = np.unique(ta.pair_ids(ta.pair_ids(ta.pair_ids(row[at], ids[at]), ids[at + 1]), ids[at + 2]), return_inverse=True, return_counts=True)
    twice = at[many[same] > 1]
    cover = np.zeros(len(ids) + 3, bool)
    for i in range(3):
        cover[twice + i] = True
    out["n_repeat_words"] = _per_row(cover[: len(ids)], rows)
    ends = np.union1d(np.flatnonzero(data == 10), off[1:][off[1:] > off[:-1]]) if len(data) else np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1] + (data[np.minimum(ends[:-1], len(data) - 1)] == 10)]) if len(ends) else ends
    # a text may begin right at a line feed's place: lines are cut again at each text's first byte
    begins = np.maximum(begins, 0)
    full = np.searchsorted(start, ends) > np.searchsorted(start, begins)
    b, e = begins[full], ends[full]
    owner = np.searchsorted(off, b, side="right") - 1
    out["n_lines"] = np.bincount(owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct(ta.exact_ids(data, b, e), owner, n)
    return out


def features(docs: DataFrame, prefix: str = "", text: bool = False) -> DataFrame:
    """docs (text last) with the counts of each text as long columns, and with text=True the text still."""
    kept = [c for c in docs.columns if text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [counts(data, off) for _, _, data, off in ta.slices(batch.column("text"))]
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *(prefix + c for c in COUNTS)])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{prefix}{c}` long" for c in COUNTS)]))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules(prefix: str = "") -> dict[str, Column]:
    """Votes by rule: 1 good, -1 bad, 0 abstains."""
    c = {x: F.col(prefix + x).cast("double") for x in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1.0))

    def between(value: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
        return _vote(value, (value >= good[0]) & (value <= good[1]), (value < bad[0]) | (value > bad[1]))

    return {
        "symbols": between(c["n_symbols"] / words, (0, 0.02), (0, 0.1)),
        "capitals": between(c["n_upper"] / F.greatest(c["n_upper"] + c["n_lower"], F.lit(1.0)), (0, 0.15), (0, 0.5)),
        "repeated lines": between(c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1.0)), (0, 0.1), (0, 0.3)),
        "repeated words": between(c["n_repeat_words"] / words, (0, 0.1), (0, 0.3)),
        "word length": between(c["word_chars"] / words, (4, 9), (3, 14)),
        "vocabulary": between(c["n_distinct"] / F.sqrt(words), (6, math.inf), (4, math.inf)),
        "shouting": between(c["n_bang"] / words, (0, 0.02), (0, 0.2)),
        "punctuation": between(c["n_marks"] / F.greatest(c["word_chars"], F.lit(1.0)), (0, 0.06), (0, 0.1)),
        "words of letters": between(c["n_letter_words"] / words, (0.95, 1), (0.8, 1)),
        "words with symbols": between(c["n_symbol_words"] / words, (0, 0.05), (0, 0.2)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[list[float]]]:
    """Expectation-maximisation: log odds of good before any vote, and what each rule's vote -1, 0, 1 adds.

    Starts from rules that are right more often than wrong and keeps a weak prior towards that, so the classes can't swap.
    """
    votes, many = np.array([v for v, _ in patterns]), np.array([n for _, n in patterns], float)
    m = votes.shape[1]
    prior = np.empty((2, m, 3))
    prior[0], prior[1] = (0.3, 0.3, 0.4), (0.03, 0.17, 0.8)  # bad, good: votes -1, 0, 1
    p, share, weight = prior.copy(), 0.9, max(1.0, 0.001 * many.sum())
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2)
    for _ in range(rounds):
        log = np.stack([np.log((p[c] * hot).sum(axis=2)).sum(axis=1) for c in (0, 1)])
        log += np.log([[1 - share], [share]])
        post = np.exp(log - np.logaddexp(log[0], log[1]))
        for c in (0, 1):
            w = post[c] * many
            p[c] = (np.einsum("i,ijk->jk", w, hot) + weight * prior[c]) / (w.sum() + weight)
        share = float(np.clip((post[1] * many).sum() / many.sum(), 1e-3, 1 - 1e-3))
    return math.log(share / (1 - share)), np.log(p[1] / p[0]).tolist()


def log_odds(voted: DataFrame, votes: list[Column]) -> Column:
    """Fitted on the patterns of voted (votes: array<int>): log odds of good, of these votes."""
    patterns = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()]  # at most 3 ** rules
    if not patterns:
        return F.lit(0.0)
    first, adds = fit(patterns)
    odds = F.lit(first)
    for v, (bad, none, good) in zip(votes, adds, strict=True):
        odds = odds + F.when(v == -1, F.lit(bad)).when(v == 1, F.lit(good)).otherwise(F.lit(none))
    return odds


def failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > int(100 * MAX_REPEAT) * F.col(f"{prefix}n_words"))


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the counts, votes, base_failed, quality (posterior), kept of each row of docs.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: quality is at least a half
    and the base rule holds.
    """
    found = features(docs.select("doc_id", "text"))
    found = written(spark, found.withColumn("votes", F.array(*rules().values()).cast("array<int>")))
    odds = log_odds(found, [F.col("votes")[j] for j in range(len(rules()))])
    found = found.withColumn("base_failed", failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that `judge` keeps, all columns as they are."""
    votes = F.array(*rules().values()).cast("array<int>")
    prefix = "_q"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    odds = log_odds(features(docs.select("text")).select(votes.alias("votes")), list(rules(prefix).values()))
    return features(docs, prefix, True).where(~failed(prefix) & (odds >= 0)).select(*docs.columns)
