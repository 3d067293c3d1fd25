"""Whole texts as flat byte arrays: spans of words and lines and their 64-bit
hashes, computed with numpy over a batch of texts at once.

A word is a run of bytes outside blank and \\t..\\r, the same as a run of such
code points.  Work arrays are made for a few megabytes at a time, also within
one very long text.
"""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = 500_000          # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_WEIGHTS: dict[int, np.ndarray] = {}


def _weights(seed: int, n: int) -> np.ndarray:
    w = _WEIGHTS.get(seed)
    if w is None or len(w) < n:
        w = stream(seed, max(4096, n)) | np.uint64(1)
        if n <= 1 << 20:
            _WEIGHTS[seed] = w
    return w


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start+1, ... for each (start, length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> np.ndarray:
    """64-bit hash of the bytes in each span (an empty span has one too); one
    row for each seed if there are several."""
    seeds = seeds or (1,)
    out = np.empty((len(seeds), len(starts)), np.uint64)
    lengths = ends - starts
    done = np.cumsum(lengths)
    k = 0
    while k < len(starts):
        base = done[k] - lengths[k]
        m = max(k + 1, int(np.searchsorted(done, base + STEP, "right")))
        s, n = starts[k:m], lengths[k:m]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(at, n)
        contiguous = len(place) and s[0] + len(place) == ends[m - 1] and np.array_equal(s[1:], ends[k:m - 1])
        data = (buf[s[0]:ends[m - 1]] if contiguous else buf[place + np.repeat(s, n)]).astype(np.uint64)
        data += np.uint64(1)
        full = n > 0
        for row, seed in zip(out, seeds, strict=True):
            sums = np.zeros(m - k, np.uint64)
            if len(data):
                value = _weights(seed, int(n.max()))[place]
                value *= data
                sums[full] = np.add.reduceat(value, at[full])
            row[k:m] = mix(sums + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k = m
    return out if len(seeds) > 1 else out[0]


def return_memory() -> None:
    """Give freed memory back to the system, where the C library can: a
    Python worker lives on after its task, beside the executor's heap."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


@dataclass
class Texts:
    """A batch of texts: bytes, and where each text begins and ends."""

    buf: np.ndarray          # uint8
    starts: np.ndarray       # int64, one per text
    ends: np.ndarray

    @classmethod
    def of(cls, column) -> Texts:
        """From an Arrow string array or a list of str (None: empty)."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not isinstance(column, pa.Array):
            column = pa.array(column, pa.large_string())
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        buf = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        lo, hi = int(offsets[0]), int(offsets[-1])
        return cls(buf[lo:hi], offsets[:-1] - lo, offsets[1:] - lo)

    def __len__(self) -> int:
        return len(self.starts)

    def _edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of runs of true bytes that stay within a text."""
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin = self.starts[self.starts < self.ends]
        first[begin] = inside[begin]
        finish = self.ends[self.starts < self.ends] - 1
        last[finish] = inside[finish]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Number of the text that holds each byte position."""
        return np.searchsorted(self.ends, at, "right")

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all words."""
        s, e = self._edges(~_SPACE[self.buf])
        return s, e, self.owner(s)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the non-empty \\n-split lines."""
        s, e = self._edges(self.buf != 10)
        return s, e, self.owner(s)

    def per_text(self, owner: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(owner, weights, len(self)).astype(np.int64)


def shingle_hashes(words: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words (or of all words of a text that
    has fewer, but at least one) and their text numbers."""
    counts = np.bincount(owner, minlength=n_texts)
    begin = np.cumsum(counts) - counts
    mult = stream(77, width) | np.uint64(1)
    total = len(words)
    full = np.maximum(counts - width + 1, 0)
    at = ranges(begin, full)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h += words[at + k] * mult[k]
    own = np.repeat(np.arange(n_texts), full)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short) and total:
        hs = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            hs[has] += words[begin[short[has]] + k] * mult[k]
        h = np.concatenate([mix(h), mix(hs ^ np.uint64(0x5DEECE66D))])
        own = np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        return h[order], own[order]
    return mix(h), own


def unique_by_owner(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, sorted within it; owners must ascend."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return v[keep], o[keep]
