"""Vectorised text work on Arrow batches: words, substring hashes, runs.

A text is a slice of one byte buffer.  The hash of any slice comes from a
prefix sum: ``sum(T[b_i] * B**i) mod 2**64`` over a random table ``T``,
multiplied by ``B**-start`` (B is odd, so it has an inverse) and mixed with
the length.  Two seeds give 128 bits where a decision rests on equality.

Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TABLES = [np.random.default_rng(1000 + s).integers(1, 2 ** 64, 256, dtype=U64) for s in (0, 1)]
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n + 1:
        size = 1 << max(16, n.bit_length())  # grows with the longest chunk seen
        base = _BASES[seed]
        out = []
        for b in (base, pow(base, -1, 2 ** 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = _POWERS[seed] = (out[0], out[1])
    return have


class Hasher:
    """Hashes of slices of one symbol sequence (bytes or word hashes)."""

    def __init__(self, symbols: np.ndarray, seed: int = 0):
        n = len(symbols)
        values = _TABLES[seed][symbols] if symbols.dtype == np.uint8 else symbols
        power, self.inverse = _powers(seed, n)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], dtype=U64, out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U64) * U64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k symbols from every position."""
        n = len(self.prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n] + U64(k))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def chunks(col: pa.Array, limit: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of whole texts of at
    most ``limit`` bytes and ``rows`` rows; a longer text is a group of its own."""
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """Words of the texts of a chunk: byte ranges and the text of each."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = LOWER[buf] if lower else buf
        solid = ~_SPACE[buf]
        begin, final = solid.copy(), solid.copy()
        if len(buf):
            begin[1:] &= ~solid[:-1]
            final[:-1] &= ~solid[1:]
            full = off[1:] > off[:-1]
            begin[off[:-1][full]] = solid[off[:-1][full]]
            final[off[1:][full] - 1] = solid[off[1:][full] - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(final) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        self.offsets = np.searchsorted(self.start, off, side="left")  # first word of each text

    def hashes(self, seed: int = 0) -> np.ndarray:
        return Hasher(self.buf, seed).slices(self.start, self.end)

    def strings(self, index: np.ndarray) -> list[bytes]:
        data = self.buf.tobytes()
        return [data[s:e] for s, e in zip(self.start[index].tolist(), self.end[index].tolist())]


_POS_BITS = 26


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest hash (by its upper bits) of every
    ``width`` consecutive positions."""
    top = h >> U64(_POS_BITS)
    n = len(h)
    if n < 1 << _POS_BITS:
        m = (top << U64(_POS_BITS)) | np.arange(n, dtype=U64)
        have = 1
        while have < width:
            step = min(have, width - have)
            m = np.minimum(m[:-step], m[step:])
            have += step
        return (m & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    m, at, have = top, np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        later = m[step:] < m[:-step]
        at = np.where(later, at[step:], at[:-step])
        m = np.where(later, m[step:], m[:-step])
        have += step
    return at


def runs(h: Hasher, off: np.ndarray, k: int, width: int):
    """Cut all windows of ``width`` symbols within a text into runs.

    The trigger of a window is its smallest k-gram hash (leftmost of equals):
    a function of the window's own content, so equal windows have equal
    triggers at equal offsets wherever they stand.  A run is the starts
    ``lo..hi`` that share one trigger position; its phrase is the symbols
    ``lo .. hi + width``.  Returns (text index, lo, hi, trigger position, key =
    trigger hash).
    """
    grams = h.grams(k)
    n = len(h.prefix) - 1
    if n < width:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    at = _sliding_argmin(grams, width - k + 1)  # trigger of the window from each start
    valid = np.zeros(n - width + 2, bool)
    fits = off[1:] - off[:-1] >= width
    mark = np.zeros(n + 2, np.int64)
    np.add.at(mark, off[:-1][fits], 1)
    np.add.at(mark, off[1:][fits] - width + 1, -1)
    valid[:-1] = np.cumsum(mark)[:n - width + 1] > 0
    valid = valid[:-1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(off, lo, side="right") - 1, lo, hi, at[lo], grams[at[lo]]


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the inclusive ranges, and the range of each."""
    n = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), n)
    return lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def covered(n: int, lo: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions inside any of the half-open ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d)[:n] > 0


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """List column from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)
