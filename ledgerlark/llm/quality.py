"""A generalised additive model with pairwise interactions that scores the quality of texts.

Features are counts over the bytes, words and lines of the whole text. Each is cut into quantile bins. Boosting goes
round the features; each step fits a tree of at most three leaves to the gradient over one feature's bins and adds
its shrunken leaf values to that feature's lookup table. Then the pairs of features whose joint bins explain most of
what is left get two-way tables the same way. A score is the logistic of a sum of table look-ups, one array
operation per table.

The model is fitted on at most `sample` labelled rows (those with the smallest hash of their id); everything else
is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerlark.llm import bytetext
from ledgerlark.llm.common import held_out, keyed_text, table

SAMPLE, THRESHOLD = 20_000, 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, MIN_LEAF = 120, 60, 0.15, 1.0, 5
SLICE = 192

FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "exclaim", "bar", "ender", "wide", "byte_entropy", "distinct_words", "top_word", "distinct_pairs", "lines", "line_words", "distinct_lines", "long_words", "short_words"]


def _entropy(counts: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    p = counts / total
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    data, offsets = bytetext.buffers(column)
    n = len(offsets) - 1
    hist = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offsets)) + data, minlength=256 * n).reshape(n, 256)
    byte = np.arange(256)
    is_upper, is_digit = (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57)
    is_lower, is_wide = (byte >= 97) & (byte <= 122), byte >= 128
    is_space = np.isin(byte, [32, 9, 10, 11, 12, 13])
    is_symbol = ~(is_upper | is_digit | is_lower | is_wide | is_space) & ~np.isin(byte, [ord(c) for c in ".,;:'\"-?()"])
    w = bytetext.Words(data, offsets)
    lines = bytetext.Words(data, offsets, bytetext.LINE_END)
    count, n_lines = np.diff(w.doc), np.diff(lines.doc)
    length = w.end - w.start
    total = np.concatenate([[0], np.cumsum(length)])
    ends = lambda ok: (c := np.concatenate([[0], np.cumsum(ok)]))[w.doc[1:]] - c[w.doc[:-1]]
    some, marks = np.maximum(count, 1), np.maximum((hist * ~is_space).sum(axis=1), 1)
    distinct, top, pairs, uniq_lines = (np.zeros(n) for _ in range(4))
    for i in range(n):
        h = w.hash[w.doc[i] : w.doc[i + 1]]
        if len(h):
            c = np.unique(h, return_counts=True)[1]
            distinct[i], top[i] = len(c) / len(h), c.max() / len(h)
            pairs[i] = len(np.unique(h[:-1] * bytetext.STEP + h[1:])) / max(len(h) - 1, 1)
            uniq_lines[i] = len(np.unique(lines.hash[lines.doc[i] : lines.doc[i + 1]])) / max(n_lines[i], 1)
    part = lambda which: hist[:, which].sum(axis=1) / marks
    out = np.column_stack([
        np.log1p(count), (total[w.doc[1:]] - total[w.doc[:-1]]) / some, part(is_upper), part(is_digit), part(is_symbol), part(byte == ord("!")), part(byte == ord("|")),
        hist[:, [ord("."), ord("?")]].sum(axis=1) / some, part(is_wide), _entropy(hist), distinct, top, pairs, np.log1p(n_lines), count / np.maximum(n_lines, 1), uniq_lines, ends(length >= 20) / some, ends(length <= 3) / some,
    ])
    return np.where(count[:, None] > 0, out, 0.0)


@dataclass
class Model:
    """bias and lookup tables; edges: inner borders of each feature's bins; coarse: its bin -> pair bin."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -500, 500)))


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; gain 0 if none leaves MIN_LEAF rows on both sides."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = gl**2 / (hl + RIDGE) + (g.sum() - gl) ** 2 / (h.sum() - hl + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain[(nl < MIN_LEAF) | (n.sum() - nl < MIN_LEAF)] = 0
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf value of each bin in a tree of at most two cuts."""
    borders = [0, len(g)]
    for _ in range(2):
        found = [(*_cut(g[a:b], h[a:b], n[a:b]), a) for a, b in zip(borders[:-1], borders[1:], strict=True)]
        gain, at, a = max(found)
        if gain <= 0:
            break
        borders = sorted([*borders, a + at])
    value = np.zeros(len(g))
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return value


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree on a grid that cuts both sides once: its gain and the value of each cell."""
    sg, sh = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    a, b = sg.shape
    rows, cols = np.arange(1, a - 1)[:, None], np.arange(1, b - 1)[None, :]
    if not rows.size or not cols.size:
        return 0.0, np.zeros(g.shape)
    part = lambda s: (s[rows, cols], s[rows, -1] - s[rows, cols], s[-1, cols] - s[rows, cols], s[-1, -1] - s[rows, -1] - s[-1, cols] + s[rows, cols])
    gain = sum(x**2 / (y + RIDGE) for x, y in zip(part(sg), part(sh), strict=True))
    r, c = np.unravel_index(gain.argmax(), gain.shape)
    value, (r, c) = np.zeros(g.shape), (int(r) + 1, int(c) + 1)
    for i, j in ((slice(None, r), slice(None, c)), (slice(None, r), slice(c, None)), (slice(r, None), slice(None, c)), (slice(r, None), slice(c, None))):
        value[i, j] = g[i, j].sum() / (h[i, j].sum() + RIDGE)
    return float(gain.max()), value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Without labels every text scores 1; with labels of one kind the share of them, smoothed, is the score."""
    n, ones = len(y), float(y.sum())
    prior = (ones + 1) / (n + 1 + (n > 0))
    model = Model(float(np.log(prior) - np.log1p(-prior)) if prior < 1 else 500.0)
    if n == 0 or ones in (0, n):
        return model
    model.bias = float(np.log(ones / (n - ones)))
    quantiles = np.arange(1, BINS) / BINS
    model.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(n, model.bias)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-f))
            sums = [np.bincount(bins[:, j], v, len(t)) for v in (y - p, p * (1 - p), np.ones(n))]
            step = RATE * _tree(*sums)
            t += step
            f += step[bins[:, j]]
    p = 1 / (1 + np.exp(-f))
    model.coarse = [np.arange(len(t)) * min(PAIR_BINS, len(t)) // len(t) for t in model.tables]
    grid = [c[bins[:, j]] for j, c in enumerate(model.coarse)]
    width = [c[-1] + 1 for c in model.coarse]

    def sums(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(grid[i] * width[j] + grid[j], v, width[i] * width[j]).reshape(width[i], width[j])

    gains = [(_quarters(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0], i, j) for i in range(len(width)) for j in range(i)]
    chosen = [(i, j, np.zeros((width[i], width[j]))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            p = 1 / (1 + np.exp(-f))
            step = RATE * _quarters(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1]
            t += step
            f += step[grid[i], grid[j]]
    model.pairs = chosen
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the labelled documents outside the held-out fold, at most `sample` of them. Ids with different or null
    labels are left out. Of several rows of one id all are used; a null text is empty."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label")
    texts = keyed_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["doc_id", "label", *FEATURES])

    rows = texts.mapInArrow(run, ", ".join(["doc_id long", "label int", *[f"{f} double" for f in FEATURES]]))
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample).toArrow()
    x = np.column_stack([got[f].to_numpy() for f in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got["label"].to_numpy().astype(float) if got.num_rows else np.zeros(0))


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, text_col: str = "text", out_col: str = "quality_score") -> DataFrame:
    """The given columns (all of them if not given) and out_col, the score of each row, from its whole text."""
    columns = docs.columns if columns is None else columns
    names = [f"c{i}" for i in range(len(columns))]  # positions, so that no name clashes
    plain = docs.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("scored"))
    schema = plain.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(features(part.column(part.num_columns - 1))))], names=[*names, "quality_score"])

    out = plain.mapInArrow(run, StructType([*schema, StructField("quality_score", DoubleType())]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)], F.col("quality_score").alias(out_col))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; empty and null texts are scored too, repeated rows alike, a null doc_id stays null."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
