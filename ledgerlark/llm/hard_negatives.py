"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, so that all have the norm M; an anchor q
gets 0. The squared distance of q and x is then |q|^2 + M^2 - 2 q.x: the highest scores are the nearest rows, and a window
of scores is an annulus around the anchor.

The top of the tree is built on a sample of at most SAMPLE rows and has at most CELLS leaves (cells). Every row goes down
to its cell; a cell's rows are cut into blocks of about BLOCK, each with a vantage-point tree of its own. Anchors are taken
in groups of about HELD, which bounds what is broadcast: a group goes to all tasks, and each block is read once for it, so
neither rows nor anchors are copied for their pairs. A group first searches the anchors' own cells, which bounds what can
still matter; it then goes to all other blocks whose distances from the vantage points of their cell can meet what is left
of its annuli. Within a block the leaves are visited nearest first, for many anchors at once, until no unvisited leaf can
hold a better row. The bounds only leave out what cannot be among the best, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import settle, table

SAMPLE, CELLS = 32_768, 8_192
#: Rows of a block, rows of a leaf, anchors that visit a block at once; anchors of a group, whose best rows a task holds.
BLOCK, LEAF, QUERIES, HELD = 4_096, 256, 4_096, 65_536
#: Components of a group's anchors; blocks of a file.
COMPONENTS, TOGETHER = 1 << 23, 16
POSITIVES, NEGATIVES = 5, 3
SCALE, MOST = 256, 1 << 24
LOW, HIGH = -(1 << 62), 1 << 62


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v of the rows that take part: floor(256 x) of each component, within 2^24 either way."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    v = F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int"))
    return used.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v")).distinct()


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows; missing components are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(column.offsets.to_numpy())
    if (n == dims).all():
        return flat.reshape(len(n), dims).astype(np.float64)
    out = np.zeros((len(n), dims))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _exact(most: float) -> type:
    """The kind of number that inner products and all their partial sums, which `most` bounds, fit without rounding."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


class Tree:
    """A vantage-point tree. vantage and radius of inner nodes, children inside and outside (a leaf l is -1 - l); path has
    each leaf's vantages from the root, -1 beyond its depth; member tells the leaf of each row that it was built on."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.x, self.vantage, self.radius, self.inside, self.outside, paths = x, [], [], [], [], []
        self.member = np.zeros(len(x), np.int64)

        def grow(rows: np.ndarray, leaves: int, path: list[int]) -> int:
            if leaves < 2 or len(rows) < 2:
                self.member[rows] = len(paths)
                paths.append(path)
                return -len(paths)
            far = _distances(x[rows], x[rows].mean(0, keepdims=True))[:, 0]
            vantage = rows[int(np.argmax(far))]
            d = _distances(x[rows], x[vantage : vantage + 1])[:, 0]
            radius = float(np.median(d))
            near = d < radius
            if not near.any():
                self.member[rows] = len(paths)
                paths.append(path)
                return -len(paths)
            node = len(self.vantage)
            for column, value in ((self.vantage, vantage), (self.radius, radius), (self.inside, 0), (self.outside, 0)):
                column.append(value)
            self.inside[node] = grow(rows[near], leaves // 2, [*path, node])
            self.outside[node] = grow(rows[~near], leaves - leaves // 2, [*path, node])
            return node

        self.root = grow(np.arange(len(x)), leaves, []) if len(x) else -1
        self.leaves = max(len(paths), 1)
        self.depth = max([len(p) for p in paths], default=0)
        self.path = np.full((self.leaves, max(self.depth, 1)), -1)
        for i, p in enumerate(paths):
            self.path[i, : len(p)] = p
        self.points = x[self.vantage] if self.vantage else np.zeros((0, x.shape[1]))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root)
        radius, inside, outside = np.array(self.radius), np.array(self.inside), np.array(self.outside)
        while (open_ := np.flatnonzero(at >= 0)).size:
            gap = x[open_] - self.points[at[open_]]
            near = np.sqrt(np.einsum("ij,ij->i", gap, gap)) < radius[at[open_]]
            at[open_] = np.where(near, inside[at[open_]], outside[at[open_]])
        return -1 - at


def _ranges(path: np.ndarray, distances: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance of each leaf's rows from each vantage of its path."""
    low, high = np.full(path.shape, 0.0), np.full(path.shape, np.inf)
    for k in range(path.shape[1]):
        has = path[leaf, k] >= 0
        d = distances[np.flatnonzero(has), path[leaf[has], k]]
        lo, hi = np.full(len(path), np.inf), np.zeros(len(path))
        np.minimum.at(lo, leaf[has], d)
        np.maximum.at(hi, leaf[has], d)
        used = path[:, k] >= 0
        low[used, k], high[used, k] = lo[used], hi[used]
    return low, high


def _score_bounds(square: np.ndarray, to_vantage: np.ndarray, path: np.ndarray, low: np.ndarray, high: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and the highest score that a leaf can hold for each query, by the triangle inequality."""
    near, far = np.zeros((len(square), len(path))), np.full((len(square), len(path)), np.inf)
    for k in range(path.shape[1]):
        used = np.flatnonzero(path[:, k] >= 0)
        d = to_vantage[:, path[used, k]]
        near[:, used] = np.maximum(near[:, used], np.maximum(d - high[used, k], low[used, k] - d))
        far[:, used] = np.minimum(far[:, used], d + high[used, k])
    slack = 1 + 1e-6 * most  # distances near 0 are roots of rounding errors
    return (square[:, None] + most - far**2) / 2 - slack, (square[:, None] + most - near**2) / 2 + slack


BLOCKS = "cell int, dims int, ids binary, labels binary, vectors binary, leaf binary, path_low array<double>, path_high array<double>"


def _blocks(placed: DataFrame, per_cell: dict[int, int], top, dims: int, most: float) -> DataFrame:
    """A row for each block: rows by leaf and id, and the range of their distances from each vantage of the cell's path."""

    def build(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, labels, cell = (group.column(c).to_numpy() for c in ("vec_id", "label", "cell"))
        x = _matrix(group.column("v").chunk(0), dims)
        rows = _augmented(x, most)
        leaf = Tree(rows, max(1, len(ids) // LEAF)).member
        order = np.lexsort((ids, leaf))
        path = top.value.path[cell[0]]
        path = path[path >= 0]
        d = _distances(rows, top.value.points[path]) if len(path) else np.zeros((len(rows), 0))
        out = [[cell[0]], [dims], [ids[order].tobytes()], [labels[order].tobytes()], [x[order].astype(np.int32).tobytes()], [leaf[order].astype(np.int32).tobytes()], [d.min(0)], [d.max(0)]]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(o, t) for o, t in zip(out, types, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    spark = placed.sparkSession
    counts = {c: max(1, math.ceil(n / BLOCK)) for c, n in per_cell.items()}
    parts = spark.createDataFrame(list(counts.items()), "cell int, parts int")  # at most CELLS rows
    cut = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "label"), F.col("parts")))
    built = cut.select("cell", "part", "vec_id", "label", "v").groupBy("cell", "part").applyInArrow(build, BLOCKS)
    # A block is about a second of work for a group: files are few blocks, dealt out evenly.
    files = max(3 * spark.sparkContext.defaultParallelism, math.ceil(sum(counts.values()) / TOGETHER))
    return built.repartition(max(1, min(files, sum(counts.values()))))


def _gathered(asked: DataFrame, dims: int, most: float) -> tuple[np.ndarray, ...]:
    """Of a group's anchors, by cell: ids, labels, cells and vectors; slot, low and high of their windows, HIGH and LOW
    where an anchor has fewer of them than another."""
    group = asked.toArrow()  # about HELD anchors
    ids, labels, cells = (group.column(c).to_numpy() for c in ("anchor_id", "label", "cell"))
    x = _matrix(group.column("v").combine_chunks(), dims).astype(_exact(most))
    windows = group.column("windows").combine_chunks()
    n, flat = np.diff(windows.offsets.to_numpy()), windows.flatten()
    row = np.repeat(np.arange(len(n)), n)
    column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    slots, low, high = (np.full((len(n), max(n, default=0)), none) for none in (-1, HIGH, LOW))
    for array, name in ((slots, "slot"), (low, "low"), (high, "high")):
        array[row, column] = flat.field(name).to_numpy()
    order = np.argsort(cells, kind="stable")
    return tuple(z[order] for z in (ids, labels, cells, x, slots, low, high))


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row by score, then id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


FOUND = "anchor_id long, slot long, score long, vec_id long"


def _visit(blocks: DataFrame, asked: Broadcast, top: Broadcast, k: int, same_label: bool, most: float, own: bool) -> DataFrame:
    """The best rows of each task for each window of a group of anchors, from their own cells or from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, own_labels, cells, q, slots, low, high = asked.value
        square = np.einsum("ij,ij->i", q, q, dtype=np.float64)
        best, best_ids, need = np.full((*slots.shape, k), LOW), np.full((*slots.shape, k), HIGH), low.copy()

        def look(who: np.ndarray, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
            """Rows of a leaf, for the anchors that visit it."""
            score = q[who] @ x.T
            # Most rows are out by now: only those of anchors that may have a better one are looked at.
            some = np.flatnonzero(((score >= need[who].min(1).astype(score.dtype)[:, None]) & (score <= high[who].max(1).astype(score.dtype)[:, None])).any(1))
            who = who[some]
            fits = ((labels[None] == own_labels[who, None]) == same_label) & (ids[None] != anchors[who, None])
            score = np.where(fits, score[some].astype(np.int64), LOW)
            for p in range(slots.shape[1] if len(who) else 0):
                fits = (score >= need[who, p, None]) & (score <= high[who, p, None])
                some = np.flatnonzero(fits.any(1))
                if not len(some):
                    continue
                found, at = np.where(fits[some], score[some], LOW), who[some]
                order = np.argsort(-found, axis=1, kind="stable")[:, :k]  # ids rise within a leaf
                found = np.take_along_axis(found, order, 1)
                found_ids = np.where(found > LOW, ids[order], HIGH)
                best[at, p], best_ids[at, p] = _top(np.concatenate([best[at, p], found], 1), np.concatenate([best_ids[at, p], found_ids], 1), k)
                need[at, p] = np.maximum(need[at, p], best[at, p, -1])

        for batch in batches:
            for r in range(batch.num_rows):
                cell, dims, ids, labels, vectors, leaf, path_low, path_high = (batch.column(c)[r].as_py() for c in range(8))
                ids, labels, leaf = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(leaf, np.int32)
                x = np.frombuffer(vectors, np.int32).reshape(len(ids), dims).astype(q.dtype)
                path = top.value.path[cell]
                path = path[path >= 0]
                starts = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
                n_leaves = len(starts) - 1
                rows = _augmented(x.astype(np.float64), most)
                # Each leaf is a ball around its middle row: vantages of the block's leaves, with their farthest row.
                vantage = rows[(starts[:-1] + starts[1:]) // 2]
                d = np.sqrt(np.maximum(np.einsum("ij,ij->i", g := rows - np.repeat(vantage, np.diff(starts), 0), g), 0))
                ball = np.maximum.reduceat(d, starts[:-1])[:, None]
                for start in range(0, len(anchors), QUERIES):
                    who = np.arange(start, min(start + QUERIES, len(anchors)))
                    who = who[(cells[who] == cell) == own]
                    if len(path) and not own and len(who):
                        to_vantage = _distances(np.column_stack([q[who], np.zeros(len(who))]), top.value.points[path])
                        floor, ceiling = _score_bounds(square[who], to_vantage, np.arange(len(path))[None], np.array(path_low)[None], np.array(path_high)[None], most)
                        who = who[((ceiling >= need[who]) & (floor <= high[who])).any(1)]
                    if not len(who):
                        continue
                    floor, ceiling = _score_bounds(square[who], _distances(np.column_stack([q[who], np.zeros(len(who))]), vantage), np.arange(n_leaves)[:, None], np.zeros_like(ball), ball, most)
                    within = floor[:, :, None] <= high[who][:, None]
                    reach = np.where(within.any(2), np.minimum(ceiling, high[who].max(1)[:, None] + 1.0), -np.inf)
                    turn, line = np.argsort(-reach, axis=1, kind="stable"), np.arange(len(who))
                    for step in range(n_leaves):
                        at = turn[:, step]
                        going = np.flatnonzero((within[line, at] & (ceiling[line, at][:, None] >= need[who])).any(1))
                        for one in np.unique(at[going]):
                            a, b = starts[one], starts[one + 1]
                            look(who[going[at[going] == one]], x[a:b], ids[a:b], labels[a:b])
        anchor, slot, place = np.nonzero(best > LOW)
        for i in range(0, len(anchor), HELD):
            a, p, j = anchor[i : i + HELD], slot[i : i + HELD], place[i : i + HELD]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (anchors[a], slots[a, p], best[a, p, j], best_ids[a, p, j])], names=["anchor_id", "slot", "score", "vec_id"])

    return blocks.mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """All rows of a table of quantised vectors, in cells and blocks."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        rows = settle(rows)
        squares = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
        n, self.dims, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(squares), F.lit(0))).first()
        self.n, self.most = n, float(most)
        sample = rows.select("v", F.xxhash64("vec_id", "label").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow().combine_chunks()
        x = _matrix(sample.column("v").chunk(0), self.dims) if sample.num_rows else np.zeros((0, self.dims))
        top = Tree(_augmented(x, self.most), min(CELLS, math.ceil(n / BLOCK), max(1, len(x) // 4)))
        top.x = top.member = None
        self.top = spark.sparkContext.broadcast(top)
        self.placed = settle(self._place(rows))
        per_cell = {r["cell"]: r["n"] for r in self.placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
        self.blocks = settle(_blocks(self.placed, per_cell, self.top, self.dims, self.most))

    def _place(self, rows: DataFrame) -> DataFrame:
        top, dims, most = self.top, self.dims, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = top.value.place(_augmented(_matrix(batch.column(2), dims), most))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "label", "v", "cell"])

        return rows.mapInArrow(run, "vec_id long, label long, v array<int>, cell int")

    def search(self, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
        """anchor_id, slot, score, vec_id and rank: of each query (anchor_id, slot, label, v, cell, low, high) the k rows of
        the same label, or of others, with the highest scores from low to high; of equal scores those of smaller ids."""
        spark = queries.sparkSession
        asked = settle(queries.groupBy("anchor_id", "label", "v", "cell").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows")))
        n_groups = math.ceil(asked.count() / min(HELD, max(1, COMPONENTS // max(1, self.dims))))
        found = spark.createDataFrame([], FOUND)
        for g in range(n_groups):
            group = _gathered(asked.where(F.pmod(F.xxhash64("anchor_id"), F.lit(n_groups)) == g), self.dims, self.most)
            if not len(group[0]):
                continue
            near = self._best(group, k, same_label, True)
            far = self._best((*group[:5], np.maximum(group[5], self._least(group, near, k)), group[6]), k, same_label, False)
            found = found.union(near).union(far)
        return _first(found, k)

    def _best(self, group: tuple[np.ndarray, ...], k: int, same_label: bool, own: bool) -> DataFrame:
        asked = self.blocks.sparkSession.sparkContext.broadcast(group)
        best = settle(_first(_visit(self.blocks, asked, self.top, k, same_label, self.most, own), k).drop("rank"))
        asked.destroy()
        return best

    @staticmethod
    def _least(group: tuple[np.ndarray, ...], near: DataFrame, k: int) -> np.ndarray:
        """The k-th score of each window of a group so far; LOW without one."""
        full = near.groupBy("anchor_id", "slot").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        known = full.select("anchor_id", "slot", "least").toArrow().to_pandas()  # at most a row for each window of the group
        slots = group[4]
        windows = pd.DataFrame({"anchor_id": np.repeat(group[0], slots.shape[1]), "slot": slots.ravel()})
        least = windows.merge(known.astype({"least": "Int64"}), "left", ["anchor_id", "slot"])["least"]
        return least.to_numpy(np.int64, na_value=LOW).reshape(slots.shape)


def mine(rows: DataFrame, anchor: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, of quantised rows.

    A row's score is its inner product with the anchor. An anchor's positives are its first other rows of the same label;
    for each, the first rows of other labels with a score from half to 95 hundredths of the positive's are its negatives.
    Other rows have another vec_id; equal rows count once; rows of one vec_id with other contents are rows of their own,
    and as anchors they share their vec_id's results by their own label and vector only if they agree: vec_id is to be
    unique among anchors. Vectors of fewer components than the longest are filled up with 0. Tables without rows, and
    anchors without positives or negatives, give no rows.
    """
    index = Index(rows)
    anchors = index.placed.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v", "cell")
    whole = anchors.withColumns({"slot": F.lit(0).cast("long"), "low": F.lit(LOW // 2), "high": F.lit(HIGH)})
    first = settle(index.search(whole, positives, True).select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p in whole numbers; below 0 nothing can be in between.
    window = [F.expr("(positive_score + 1) div 2").alias("low"), F.expr("(19 * positive_score) div 20").alias("high")]
    annuli = anchors.join(first, "anchor_id").where("positive_score >= 0").select("anchor_id", "label", "v", "cell", "slot", *window).where("low <= high")
    found = index.search(annuli, negatives, False)
    return found.join(first, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of every anchor; labels of rows whose vec_id is divisible by 7 move on."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(quantised(rows))


#: DuckDB SQL for op12_hard_negatives: all rows against all anchors.
ORACLE_SQL = """
with r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.v, b.v)::bigint as s from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), f as (select anchor_id, vec_id as positive_id, s as positive_score from (select *, row_number() over (partition by anchor_id order by s desc, vec_id) as k from p where same) where k <= 5
), n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, s as negative_score, row_number() over (partition by anchor_id, positive_id order by s desc, vec_id)::int as rank
  from p join f using (anchor_id) where not same and 50 * positive_score <= 100 * s and 100 * s <= 95 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
