"""Partial string similarity from its public definition."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def bag(c: Column) -> Column:
    """The characters of a text, each with how often it stood before, so that equal ones differ: the common elements of two
    bags are the characters that the texts have in common, with repeats."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, F.lit(1), i), lambda y: y == x)).cast("string")))


def bound(a: Column, b: Column, bag_a: Column, bag_b: Column) -> Column:
    """No partial_ratio of a and b is higher. A common subsequence has no more characters than the bags have in common, and
    a window that is cut off has no fewer than it. Null bags have nothing in common."""
    m = F.least(F.char_length(a), F.char_length(b))
    common = F.least(F.coalesce(F.size(F.array_intersect(bag_a, bag_b)), F.lit(0)), m)
    return F.when(m > 0, 200.0 * common / (m + common)).when(a == b, F.lit(100.0)).otherwise(F.lit(0.0))


def _common(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence, by bit operations; masks: the places of each character."""
    free = (1 << size) - 1
    full = free
    for c in other:
        hit = free & masks.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


def _one_way(short: str, long: str) -> float:
    m, n = len(short), len(long)
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    best = 0.0
    for start in range(1 - m, n):  # windows of m characters, cut off at both ends
        window = long[max(start, 0) : start + m]
        if window and 200 * min(len(window), m) > best * (m + len(window)):
            best = max(best, 200 * _common(masks, m, window) / (m + len(window)))
    return best


def partial_ratio(a: str, b: str) -> float:
    """100 times the best normalised InDel similarity of the shorter text with a window of the longer one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_one_way(a, b), _one_way(b, a))
    return _one_way(*sorted((a, b), key=len))


def _all_one_way(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """_one_way of many pairs at once; rows are the code points of texts, of at most 63 in short."""
    m, n = short.shape[1], long.shape[1]
    full = np.uint64((1 << m) - 1)
    masks = [np.zeros(len(short), np.uint64) for _ in range(n)]
    for j in range(n):
        for i in range(m):
            masks[j] |= (short[:, i] == long[:, j]).astype(np.uint64) << np.uint64(i)
    best = np.zeros(len(short))
    for start in range(1 - m, n):
        window = masks[max(start, 0) : start + m]
        free = np.full(len(short), full)
        for mask in window:
            hit = free & mask
            free = ((free + hit) | (free - hit)) & full
        best = np.maximum(best, 200 * (m - np.bitwise_count(free).astype(np.int64)) / (m + len(window)))
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """partial_ratio of each pair; pairs of equal lengths are compared at once."""
    out = np.zeros(len(a))
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(pairs):
        groups.setdefault((len(x), len(y)), []).append(k)
    for (m, n), where in groups.items():
        if m == 0 or m > 63 or len(where) < 8:
            out[where] = [partial_ratio(*pairs[k]) for k in where]
            continue
        short, long = (np.array([pairs[k][side] for k in where], f"<U{size}").view(np.uint32).reshape(len(where), size) for side, size in ((0, m), (1, n)))
        out[where] = np.maximum(_all_one_way(short, long), _all_one_way(long, short)) if m == n else _all_one_way(short, long)
    return out


@F.pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratios([x or "" for x in a], [x or "" for x in b]), dtype=float)
