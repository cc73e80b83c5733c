"""Words of many texts at once, straight from Arrow buffers.

A batch is one array of UTF-8 bytes. Word borders, word hashes and shingle hashes are array operations over all
its texts, so no Python object is made per word. Only A-Z are lower-cased; space and the control characters 9 to
13 separate words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Odd multipliers: of the rolling polynomial, and of the steps that mix words into shingles.
BASE = _U(0x9E3779B97F4A7C15)
BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = _U(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Only the line feed, to take lines as words.
LINE_END = np.zeros(256, dtype=bool)
LINE_END[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes are spread over 64 bits before they enter the polynomial.
_SPREAD = np.random.Generator(np.random.PCG64(20250101)).integers(1, 1 << 63, 256, dtype=np.uint64)

_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string or binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """hash: of each word; doc: bounds of each row's words; start, end: byte positions of the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE):
        lowered = _LOWER[data]
        n = len(lowered)
        inside = np.empty(n + 2, dtype=bool)
        inside[0] = inside[-1] = False
        np.logical_not(separator[lowered], out=inside[1:-1])
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[1:-1][cuts]  # a text ends its last word even if the next text begins at once
        last[cuts - 1] = inside[1:-1][cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, offsets)
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SPREAD[lowered] * up[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        self.hash = mix(raw + (self.end - self.start).astype(np.uint64) * STEP)


def words(column: pa.Array) -> Words:
    return Words(*buffers(column))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words of each row (of all its words where it has fewer), and the rows' bounds."""
    counts = np.diff(w.doc)
    short = (counts > 0) & (counts < size)
    per_row = np.where(counts >= size, counts - size + 1, short.astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    h, n = w.hash, len(w.hash)
    if n < size:
        runs = np.zeros(0, np.uint64)
    else:
        runs = h[: n - size + 1].copy()
        for k in range(1, size):
            runs = runs * STEP + h[k : n - size + 1 + k]
        runs = mix(runs + _U(size))
    out = np.empty(bounds[-1], dtype=np.uint64)
    full = np.flatnonzero(counts >= size)
    if len(full):
        row = np.repeat(full, per_row[full])
        within = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(per_row[full])[:-1]]), per_row[full])
        out[bounds[row] + within] = runs[w.doc[row] + within]
    for r in np.flatnonzero(short):
        own = h[w.doc[r] : w.doc[r + 1]]
        acc = own[:1].copy()
        for k in range(1, len(own)):
            acc = acc * STEP + own[k : k + 1]
        out[bounds[r]] = mix(acc + _U(len(own)))[0]
    return out, bounds


def distinct_sets(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each row."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def slices(batch: pa.RecordBatch, column: int, at_most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts have about so many bytes together; a longer text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + at_most, "right")))
        yield batch.slice(at, to - at)
        at = to
