"""Vectorised words, hashes and shingles of Arrow string arrays (numpy), whole texts, no Python loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer piece is only made where no white space allows a cut.
PIECE = 1 << 20
_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, A-Z as a-z; which bytes are white space."""
    values = mix(np.arange(1, 257, dtype=_U) * _U(_ODD[0]))
    values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


@lru_cache(maxsize=1)
def _exact() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_ODD[0]))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE) + 1
        base = 0x9E3779B97F4A7C15 | 1
        _POWERS[:] = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, _U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1, from 0) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all words; a text's end ends a word."""
    solid = ~(_tables()[1] if space is None else space)[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid
    stop = stop.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of the bytes data[starts:ends], A-Z as a-z if fold. Spans are in order of their starts and short against PIECE."""
    out = np.empty(len(starts), _U)
    values = _tables()[0] if fold else _exact()
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(int(np.searchsorted(starts, lo + PIECE)), i + 1)
        hi = int(ends[i:j].max())
        p, q = _powers(hi - lo)
        c = np.zeros(hi - lo + 1, _U)
        np.cumsum(values[data[lo:hi]] * p[: hi - lo], out=c[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (c[e] - c[s]) * q[s] + (e - s).astype(_U) * _U(_ODD[1])
        i = j
    return mix(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and n + 1 places at which the texts' words begin."""
    data, offsets = buffers(texts)
    starts, ends = word_bounds(data, offsets)
    return span_hash(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words (of the whole sequence if it has 1 to k - 1 words), and where each text's begin.

    Not yet distinct."""
    h, at = words(texts)
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    out = np.empty(begin[-1], _U)
    if len(h) >= k:
        run = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            run += h[i : len(h) - k + 1 + i] * _U(_ODD[i % 5] + 2 * (i // 5))
        run = mix(run)
        long = n >= k
        c, b = count[long], begin[:-1][long]
        first = at[:-1][long]
        total = int(c.sum())
        if total:
            within = np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            out[np.repeat(b, c) + within] = run[np.repeat(first, c) + within]
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = np.full(1, n[d], _U)
        for w in h[at[d] : at[d + 1]]:
            x = mix(x * _U(_ODD[2]) + w)
        out[begin[d]] = x[0]
    return out, begin
