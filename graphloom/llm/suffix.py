"""Suffix sorting of a shard by the difference cover modulo 3, and a wavelet-tree index over its transform."""

from __future__ import annotations

import numpy as np

from graphloom.llm.textarrays import ragged


def packed(*keys: np.ndarray) -> np.ndarray:
    """Tuples of small non-negative integers as integers in the same order."""
    out, room = keys[0].astype(np.int64), int(keys[0].max(initial=0)) + 1
    for k in keys[1:]:
        size = int(k.max(initial=0)) + 1
        if room * size >= 1 << 62:  # rank what there is so far
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            room = int(out.max(initial=0)) + 1
        out = out * size + k
        room *= size
    return out


def names(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of tuples of small non-negative integers, and how many differ."""
    key = packed(*keys)
    order = np.argsort(key)
    ordered = key[order]
    rank = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(key), np.int64)
    out[order] = rank
    return out, int(rank[-1]) if len(rank) else 0


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t, integers from 1 on: sample, name triples, recurse, place the rest, merge."""
    n = len(t)
    if n <= 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    x = np.concatenate([t.astype(np.int64), np.zeros(4, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    name, many = names(x[sample], x[sample + 1], x[sample + 2])
    if many < len(sample):
        order = suffix_array(name)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(1, len(sample) + 1)
        sample = sample[order]
    else:
        sample = sample[np.argsort(name)]
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(packed(x[zeros], rank[zeros + 1]))]
    # merge: suffixes at 0 modulo 3 are compared with those at 1 by (symbol, rank), at 2 by (symbol, symbol, rank)
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.zeros(len(zeros), np.int64)
    for other, key in ((ones, lambda i: (x[i], rank[i + 1])), (twos, lambda i: (x[i], x[i + 1], rank[i + 2]))):
        both = packed(*(np.concatenate([a, b]) for a, b in zip(key(other), key(zeros), strict=True)))  # each half is sorted
        before += np.searchsorted(both[: len(other)], both[len(other) :])
    at = np.arange(len(zeros)) + before
    out = np.empty(n, np.int64)
    mine = np.zeros(n, bool)
    mine[at] = True
    out[at] = zeros
    out[~mine] = sample
    return out


def joined(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments as one text in which a separator of its own, smaller than all symbols, ends each; and where symbols went."""
    many = len(off) - 1
    size = np.diff(off)
    where = np.arange(len(symbols)) + np.repeat(np.arange(many), size)
    text = np.empty(len(symbols) + many, np.int64)
    text[where] = symbols.astype(np.int64) + many + 1
    text[off[1:] + np.arange(many)] = np.arange(1, many + 1)
    return text, where


def repeats_by_suffixes(symbols: np.ndarray, off: np.ndarray, length: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For each window of each segment (bytes) asked for (default: all), in order: does it occur twice? Segments that are
    equal byte by byte are sorted once, as a segment with two places; adjacent suffixes share the longest prefixes."""
    segments = [symbols[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(x, len(known)) for x in segments], np.int64)
    many = np.bincount(which, minlength=len(known)) > 1
    size = np.array([len(x) for x in known], np.int64)
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    symbols = np.frombuffer(b"".join(known), np.uint8)
    windows = np.maximum(0, size - length + 1)
    twice = np.zeros(len(symbols), bool)
    twice[ragged(off[:-1][many], windows[many])] = True
    text, where = joined(symbols, off)
    order = suffix_array(text)
    back = np.full(len(text), -1, np.int64)
    back[where] = np.arange(len(symbols))
    order = back[order]
    starts = np.zeros(len(symbols), bool)
    starts[ragged(off[:-1], windows)] = True
    a, b = order[:-1], order[1:]
    ok = (a >= 0) & (b >= 0)
    ok[ok] = starts[a[ok]] & starts[b[ok]]
    a, b = a[ok], b[ok]
    wide = np.zeros(len(symbols) + 8, np.uint64)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(16, np.uint64)])
    for i in range(8):
        wide |= padded[i : i + len(wide)] << np.uint64(8 * i)
    steps = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for s in steps:
        same = wide[a + s] == wide[b + s]
        a, b = a[same], b[same]
    if length < 8:
        for s in range(length):
            same = symbols[a + s] == symbols[b + s]
            a, b = a[same], b[same]
    twice[a] = True
    twice[b] = True
    which = which if asked is None else which[asked]
    return twice[ragged(off[:-1][which], windows[which])]


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of a shard, held in a wavelet tree stored level by level."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        last = text[order - 1]  # the symbol before suffix 0 is the last separator
        self.n = len(text)
        self.depth = max(1, int(text.max(initial=1)).bit_length())
        counts = np.bincount(text, minlength=1 << min(self.depth, 62) if self.depth <= 24 else int(text.max()) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (last >> level) & 1
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.ones.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bitwise_count(words), dtype=np.int32)]))
            self.zeros.append(self.n - int(bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in the transform's first i places, less those that sort before it: a place in its run."""
        for level in range(self.depth):
            words, ones = self.bits[level], self.ones[level]
            w = i >> 6
            r = ones[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            bit = (symbol >> (self.depth - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + r, i - r)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with symbol and go on as those in [lo, hi); base: rank(symbol, 0)."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        first = self.before[symbol] - base
        return first + both[: len(symbol)], first + both[len(symbol) :]


def repeats_by_index(symbols: np.ndarray, off: np.ndarray, length: int, asked: np.ndarray | None = None) -> np.ndarray:
    """For each window of each segment (word hashes) asked for (default: all), in order: does it occur twice? By backward search in the index.

    The segments asked for are streamed side by side. A lane tries the string from its first open window to some end: as long as
    the interval holds two suffixes, it goes on to the left. Where it fails, the string is unique, and so is every
    window that holds it, while windows right of it are repeated. After a success the next end lies further on.
    """
    _, ids = np.unique(symbols, return_inverse=True)
    text, where = joined(ids, off)
    index = FMIndex(text)
    base_of = index.rank(np.arange(int(text.max()) + 1), np.zeros(int(text.max()) + 1, np.int64))
    twice = np.zeros(len(symbols) + 1, np.int64)  # as differences
    size = np.diff(off)
    asked = np.ones(len(size), bool) if asked is None else asked
    lane = np.flatnonzero((size >= length) & asked)
    first, last = off[lane].copy(), off[lane + 1] - length  # open windows
    reach = np.zeros(len(lane), np.int64)
    end = first + length
    pos, lo, hi = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), index.n, np.int64)
    while len(first):
        pos -= 1
        symbol = text[where[pos]]
        lo, hi = index.step(symbol, lo, hi, base_of[symbol])
        fail = hi - lo < 2
        done = fail | (pos == first)
        if not done.any():
            continue
        d = np.flatnonzero(done)
        f, p, e, a = fail[d], pos[d], end[d], first[d]
        begin = np.where(f, p + 1, a)  # windows begin .. e - length are repeated
        stop = e - length + 1
        good = begin < stop
        np.add.at(twice, begin[good], 1)
        np.add.at(twice, stop[good], -1)
        # not repeated: windows e - length .. p where the string failed at p; with reach 0 that closes first .. p
        short = f & (reach[d] == 0)
        closed_all = ~f
        first[d] = np.where(short, p + 1, np.where(closed_all, stop, a))
        reach[d] = np.where(closed_all, np.maximum(1, 2 * reach[d] + 1), np.where(reach[d] > 0, np.minimum(reach[d] // 2, np.maximum(0, np.minimum(p, stop - 2) - a)), 0))
        keep = first <= last
        reach = np.minimum(reach, np.maximum(0, last - first))
        fresh = done & keep
        end = np.where(fresh, first + length + reach, end)
        pos = np.where(fresh, end, pos)
        lo = np.where(fresh, 0, lo)
        hi = np.where(fresh, index.n, hi)
        first, last, reach, end, pos, lo, hi = (x[keep] for x in (first, last, reach, end, pos, lo, hi))
    windows = np.maximum(0, size - length + 1)
    return (np.cumsum(twice)[: len(symbols)] > 0)[ragged(off[:-1][asked], windows[asked])]
