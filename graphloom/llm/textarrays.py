"""NumPy views of Arrow text columns: words, rolling hashes and windows, in slices of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from graphloom.llm.common import WHITE

U64 = np.uint64
SLICE = 1 << 20
#: Strings are hashed by two polynomials modulo a Mersenne prime, with bases of their own.
_PRIME = U64((1 << 31) - 1)
_BASES = (1_284_865_837, 748_932_582)
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=U64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, not yet the least residue."""
    return (x & _PRIME) + (x >> U64(31))


def _residue(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _PRIME, x - _PRIME, x)


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo the prime for i < n, B the base of that number, as 32-bit integers."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, int(_PRIME))):
            p = np.ones(1, U64)
            while len(p) < (size := max(n, 1 << 16)):
                p = np.concatenate([p, _residue(p[: size - len(p)] * U64(pow(base, len(p), int(_PRIME))))])
            out.append(p.astype(np.uint32))
        have = _powers[which] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Rolling:
    """Hashes of any run of symbols in O(1), from prefix sums of symbol * B**i: 62 bits, 31 for each base.

    Different strings of n symbols share a hash with probability (n / 2**31)**2, whatever the strings are.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums, self.down = [], []
        for which, part in enumerate((symbols & _PRIME, symbols >> U64(33))):
            up, down = powers(which, n + 1)
            sums = np.zeros(n + 1, dtype=U64)
            np.cumsum(_fold(part * up[:n]), out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    def _join(self, sums: list[np.ndarray], down: list[np.ndarray]) -> np.ndarray:
        one, two = (_residue(_fold(_fold(s)) * d) for s, d in zip(sums, down, strict=True))
        return (one << U64(32)) | two

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._join([s[end] - s[start] for s in self.sums], [d[start] for d in self.down])

    def grams(self, k: int) -> np.ndarray:
        """Of the k symbols from each position on."""
        n = len(self.sums[0]) - 1
        if n < k:
            return np.zeros(0, dtype=U64)
        return self._join([s[k:] - s[: n - k + 1] for s in self.sums], [d[: n - k + 1] for d in self.down])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # the bytes under a null are undefined
        size = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if (size != np.diff(off)).any():
            data = b"".join((x.encode() if isinstance(x, str) else x or b"") for x in column.to_pylist())
            return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(size)])
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; a run is over limit only if it is one row."""
    data, off = buffers(column)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + limit, side="right")) - 1)
        yield row, last, data[off[row] : off[last]], off[row : last + 1] - off[row]
        row = last


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the offset of each row's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~WHITE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[start:end], in order of start; in pieces, so that memory does not grow with a long text."""
    out, size = np.empty(len(start), U64), end - start
    for i in np.flatnonzero(size > SLICE).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    short = np.flatnonzero(size <= SLICE)
    lo = 0
    while lo < len(short):
        first = start[short[lo]]
        hi = max(lo + 1, int(np.searchsorted(end[short], first + 2 * SLICE, side="right")))
        part = short[lo:hi]
        a, b = start[part] - first, end[part] - first
        out[part] = mix(Rolling(_TABLE[data[first : first + b[-1]]]).of(a, b) + size[part].astype(U64))
        lo = hi
    return out


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k symbols from each position on, in pieces."""
    n = max(0, len(symbols) - k + 1)
    return np.concatenate([np.zeros(0, U64), *(Rolling(symbols[lo : lo + SLICE + k - 1]).grams(k) for lo in range(0, n, SLICE))])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the size[i] bytes from a[i] on equal those from b[i] on."""
    out = np.ones(len(a), bool)
    long_ = size > 1 << 14
    for i in np.flatnonzero(long_).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    short = np.flatnonzero(~long_ & (size > 0))
    upto = np.cumsum(size[short])
    for lo, hi in zip(cuts := [0, *np.searchsorted(upto, np.arange(SLICE, upto[-1], SLICE) if len(upto) else []).tolist()], [*cuts[1:], len(short)], strict=True):
        part = short[lo:hi]
        if len(part):
            same = data[ragged(a[part], size[part])] == data[ragged(b[part], size[part])]
            out[part] = np.logical_and.reduceat(same, np.concatenate([[0], np.cumsum(size[part])[:-1]]))
    return out


def exact_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each string data[start:end], the same for equal strings alone: hashes propose, bytes decide."""
    _, one, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    rep, size = one[which], end - start
    rest = np.flatnonzero((rep != np.arange(len(start))) & (size == size[rep]))
    if len(rest) + len(one) < len(start) or not same_bytes(data, start[rest], start[rep[rest]], size[rest]).all():
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return which


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small non-negative integers, the same for equal pairs alone."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w values from each position on, by doubling."""
    if len(x) < w:
        return x[:0]
    have, m = 1, x
    while have * 2 <= w:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return m


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[i], ..., start[i] + length[i] - 1 for each i in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)
