"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A shingle's hash is placed on a circle of 2^32 positions by one permutation (sigma). A second one (pi), shifted by k
positions, gives coordinate k of the signature: the least pi(position - k) over a document's shingles. Bands of
successive coordinates are bucket keys.

Documents with equal shingle sets are one class and enter the buckets once. A bucket is never expanded into all its
pairs: its members are first compared with its first one and then, where still in different components, by a prefix
filter over their differences from the best-linked member. It leaves out only pairs that cannot be similar enough,
so a group of thousands of copies costs a few comparisons per copy while no link between the members of a bucket is
lost. Every link rests on the full shingle sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm import bytetext
from ledgerlark.llm.common import keyed_text, settle, table
from ledgerlark.llm.components import components

#: BANDS bands of ROWS coordinates miss a pair of similarity 0.8 with probability (1 - 0.8^4)^24 = 3e-6.
BANDS, ROWS = 24, 4
#: Rows of an Arrow batch that are worked on at once.
SLICE = 192

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def circulant(values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """k signature coordinates of each row of shingle hashes; starts: where each row begins, none empty."""
    circle = (bytetext.mix(values + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), k), dtype=np.uint32)
    for shift in range(k):
        out[:, shift] = np.minimum.reduceat(_pi(circle - np.uint32(shift + 1)), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(signature), b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = bytetext.mix(acc * bytetext.STEP + signature[:, b * rows + r])
        keys[:, b] = acc
    return keys.view(np.int64)


def sign(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values, bounds = bytetext.shingles(bytetext.words(part.column(1)), size)
                sets = bytetext.distinct_sets(values, bounds)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]]).astype(np.int64) if len(full) else np.zeros(0, np.int64)
                set_a, set_b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys: list = [None] * len(n)
                if len(full):
                    set_a[full] = bytetext.mix(np.add.reduceat(bytetext.mix(flat + np.uint64(1)), starts) + n[full].astype(np.uint64))
                    set_b[full] = bytetext.mix(np.bitwise_xor.reduceat(bytetext.mix(flat + np.uint64(2)), starts) + n[full].astype(np.uint64))
                    signature = circulant(flat, starts, bands * rows)
                    for i, k in zip(full, band_keys(signature, bands, rows), strict=True):
                        keys[i] = k
                cols = [part.column(0), pa.array(n), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.mapInArrow(run, SIGNED)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                left, right = (bytetext.distinct_sets(*bytetext.shingles(bytetext.words(part.column(i)), size)) for i in (2, 3))
                both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], dtype=np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], dtype=np.int64) - both
                keep = pa.array((100 * both >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """node, lead, the sizes of both sets, whether they are linked, and the shingles that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                left, right = (bytetext.distinct_sets(*bytetext.shingles(bytetext.words(part.column(i)), size)) for i in (2, 3))
                apart = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
                n, m, d = (np.array([len(x) for x in xs], np.int64) for xs in (left, right, apart))
                both = (n + m - d) // 2
                cols = [part.column(0), part.column(1), pa.array(n), pa.array(m), pa.array(100 * both >= percent * (both + d)), pa.array([x.view(np.int64) for x in apart], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "lead", "n", "n_lead", "linked", "apart"])

    own, lead = texts.select("node", F.col("text").alias("text_a")), texts.select(F.col("node").alias("lead"), F.col("text").alias("text_b"))
    rows = pairs.select("node", "lead").join(own, "node").join(lead, "lead").select("node", "lead", "text_a", "text_b")
    return rows.mapInArrow(run, "node long, lead long, n long, n_lead long, linked boolean, apart array<long>")


def _by_differences(apart: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) with a common lead that can be similar enough though they are in different components.

    One of such a pair, x, is not linked with the lead. With d(x) the shingles that only one of x and the lead has, the
    pair needs |d(x) & d(y)| >= (|d(x)| + |d(y)| - k (|x| + |y|)) / 2 where k = (1 - j) / (1 + j). So the rarest of each
    one's differences, in numbers that follow from this, have one in common, and after the first they still have room
    for the others that the pair needs: independent edits of one text do not meet.
    """
    j = percent / 100
    k = (1 - j) / (1 + j)
    each = apart.select("lead", "node", "n", "n_lead", "linked", F.size("apart").alias("d"), F.explode("apart").alias("el"))
    often = each.groupBy("lead", "el").agg(F.count("*").alias("f")).where("f > 1")
    held = each.join(often, ["lead", "el"])
    mine = Window.partitionBy("lead", "node")
    held = held.withColumn("r", F.row_number().over(mine.orderBy("f", "el"))).withColumn("shared", F.count("*").over(mine))
    loose = F.floor(F.col("n") * ((1 - j) / j) + 1e-6) + 1
    tight = F.floor((F.col("d") + k * F.greatest(F.col("n") - F.col("n_lead"), F.lit(0))) / 2 + 1e-6) + 1
    held = held.withColumn("place", F.col("d") - F.col("shared") + F.col("r"))
    kept = held.where(F.col("place") <= F.when(F.col("linked"), tight).otherwise(loose)).withColumn("after", F.col("d") - F.col("place"))
    kept = kept.select("lead", "el", "node", "linked", "n", "d", "after").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    x = kept.where("not linked").select("lead", "el", *[F.col(c).alias(f"{c}_x") for c in ("node", "component", "n", "d", "after")])
    y = kept.select("lead", "el", *[F.col(c).alias(f"{c}_y") for c in ("node", "component", "n", "d", "after")])
    room = 1 + F.least("after_x", "after_y") >= (F.col("d_x") + F.col("d_y") - k * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-6
    return x.join(y, ["lead", "el"]).where((F.col("component_x") != F.col("component_y")) & room).select(F.col("node_x").alias("x"), F.col("node_y").alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; documents of a Jaccard similarity of at least percent
    hundredths are linked, and component_id is the smallest doc_id reachable.

    Words are runs without white space, A-Z lower-cased; a text of fewer than size words is one shingle. A null,
    empty or blank text has no shingles and is linked with nothing. Rows of one doc_id are one node of the graph,
    whatever their texts. A row with a null doc_id is no node: its component_id is null and it is kept. An empty
    table gives no rows; other columns are not read.
    """
    texts = keyed_text(docs, id_col, text_col)
    signed = settle(sign(texts, size, bands, rows))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # One member stands for each class of equal sets. Tables that are joined on a hot key are written first: the join
    # is then between two plain shuffles, of which Spark can split the hot partition.
    nodes = settle(real.groupBy("set_a", "set_b").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("node")))
    classes = nodes.select("set_a", "set_b", "node")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    crowded = settle(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low"))
    shared = settle(entries.join(crowded, "key"))
    wanted = settle(texts.where("doc_id is not null").join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))

    # Each member of a bucket against its first one.
    tried = settle(shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
    links = settle(_confirmed(tried, wanted, size, percent).union(_shared_ids(real, classes)))
    comp = components(links)
    # Buckets that are still in several components: by differences from the member with most links.
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("deg"))
    tagged = settle(shared.join(comp, "node", "left").join(degree, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("deg", F.lit(0)).alias("deg")))
    best = tagged.groupBy("key", "component").agg(F.max(F.struct("deg", F.bitwise_not("node").alias("low"))).alias("best"))
    torn = settle(best.groupBy("key").agg(F.count("*").alias("k"), F.max("best").alias("best")).where("k > 1").select("key", F.bitwise_not("best.low").alias("lead")))
    pairs = tagged.select("key", "node").join(torn, "key").where("node <> lead").select("node", "lead").distinct()
    apart = settle(_differences(pairs, wanted, size, percent))
    last = settle(_by_differences(apart, comp, percent).join(tried, ["a", "b"], "left_anti"))
    more = _confirmed(last, wanted, size, percent).union(apart.where("linked").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    comp = components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    of_class = classes.join(comp, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    found = signed.join(of_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared_ids(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes in which one doc_id occurs."""
    again = settle(real.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    rows = real.select("doc_id", "set_a", "set_b").join(again, "doc_id", "left_semi").join(classes, ["set_a", "set_b"])
    several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("top")).where("a < top").select("doc_id", "a")
    return rows.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: DuckDB SQL for op7_minhash, by comparing all documents that share a shingle.
ORACLE_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select doc_id, unnest(list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end)) as sh from w
), n as (select doc_id, count(*) as n from s group by 1
), p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2
), e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), sides as (select a, b from e union all select b, a from e
), r(doc_id, reached) as (select doc_id, doc_id from documents union select sides.b, r.reached from r join sides on r.doc_id = sides.a
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.reached) as component_id, d.doc_id = min(r.reached) as kept
from documents d left join n using (doc_id) join r using (doc_id) group by d.doc_id, n.n
"""
