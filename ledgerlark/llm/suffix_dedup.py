"""Removal of repeated passages, found by suffix sorting shards that hold every pair of equal windows together.

A window is a string of WIDTH bytes. The least hash among the GRAM-byte strings in a window depends on the window alone,
so equal windows have equal least hashes. Successive windows of a document with one least hash are a run, which is about
40 windows, and all of a hash's runs are dealt to one shard. There, of runs with equal bytes all but the first one are
copies as a whole. Only where a hash has runs of different bytes, or a run has it twice, are their bytes fetched, and all suffixes of a shard's
bytes are sorted with their common prefixes by external induced sorting (induced.py): windows that are neighbours with
WIDTH bytes in common are equal, and all but the first one are marked.

First is by doc_id (null last), then by the hash of the text where a doc_id occurs again, then by position.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bytetext, induced
from ledgerlark.llm.common import settle, table

WIDTH, GRAM = 100, 24
#: Bytes of text in a piece whose windows are hashed at once, and in a block whose runs leave the task together.
PIECE, BLOCK = 1 << 19, 1 << 23
#: Bytes of text of which a shard has the runs, and bytes of fetched runs that are sorted together.
SHARD, SORTED = 16 << 20, 3 << 20
#: Runs of a shard in memory at once, beyond which they are dealt to files. Different runs of one hash, beyond which their
#: windows are compared one by one by hash in SQL: they would not fit a shard.
HELD, CROWD = 4_000_000, 65_536
LAST = (1 << 63) - 1

_U = np.uint64


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every string of so many bytes, by doubling."""
    part, width, out, done = bytetext._SPREAD[data], 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = part, width
            else:
                n = len(data) - (done + width) + 1
                out = out[:n] * _U(pow(int(bytetext.BASE), width, 1 << 64)) + part[done : done + n]
                done += width
        if 2 * width > size:
            return bytetext.mix(out)
        n = len(data) - 2 * width + 1
        part = part[:n] * _U(pow(int(bytetext.BASE), width, 1 << 64)) + part[width : width + n]
        width *= 2


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every so many successive values."""
    width, out = 1, values
    while 2 * width <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (size - width)], out[size - width :])


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """value, hash, row, start in the row and number of windows of each run, rows in order. The number is negative where
    the value's string may stand in a run twice, so that windows of one run may be equal."""
    gram = min(GRAM, max(1, width // 2))
    out: list[tuple[np.ndarray, ...]] = []
    n_windows = len(data) - width + 1
    ends = offsets[1:] - width  # the last window of each row
    for a in range(0, max(n_windows, 0), PIECE):
        b = min(a + PIECE, n_windows)
        piece = data[a : b + width - 1]
        each, per = _grams(piece, gram), width - gram + 1
        value = _least(each, per)
        pad = np.full(per - 1, ~_U(0))
        least_of = np.flatnonzero(~_least(np.concatenate([pad, ~value, pad]), per) == each)  # strings that are the least of some window
        pair = np.flatnonzero((np.diff(least_of) <= per) & (each[least_of[1:]] == each[least_of[:-1]]))
        first, last = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b - 1, "right") - 1
        low = np.maximum(offsets[first : last + 1], a) - a
        high = np.minimum(ends[first : last + 1], b - 1) - a + 1  # of the windows of each row that has any here
        some = high > low
        low, high, row = low[some], high[some], np.flatnonzero(some) + first
        if not len(low):
            continue
        cut = np.zeros(b - a + 1, bool)
        cut[1 : b - a] = value[1:] != value[:-1]
        cut[low] = True
        inside = np.zeros(b - a + 1, np.int8)
        inside[low] = 1
        np.add.at(inside, high, -1)
        start = np.flatnonzero(cut & (np.cumsum(inside, dtype=np.int8) > 0))
        of = np.searchsorted(low, start, "right") - 1
        n = np.minimum(np.append(start[1:], b - a), high[of]) - start
        if len(pair) and len(start):
            near = np.zeros(b - a + 1, np.int32)
            np.add.at(near, np.maximum(least_of[pair] - per + 1, 0), 1)
            np.add.at(near, np.minimum(least_of[pair + 1] + 1, b - a), -1)
            inner = np.maximum.reduceat(np.cumsum(near) > 0, start)
        else:
            inner = np.zeros(len(start), bool)
        up, down = bytetext._powers(len(piece) + 1)
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum(bytetext._SPREAD[piece] * up[: len(piece)], out=total[1:])
        h = bytetext.mix((total[start + n + width - 1] - total[start]) * down[start] + n.astype(_U))
        out.append((value[start], h, row[of], start + a - offsets[row[of]], np.where(inner, -n, n)))
    if not out:
        return np.zeros(0, _U), np.zeros(0, _U), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _again(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys that keeps the rows' order, and which rows of it have the keys of the row before."""
    order = np.lexsort(keys[::-1])
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in keys:
        same[1:] &= k[order[1:]] == k[order[:-1]]
    return order, same


SENT = "shard int, keys binary, ties binary, value binary, hash binary, doc binary, start binary, n binary"
#: kind 0: bytes from start up to stop are repeated; 1: a run to be fetched, of the value; 2: one of a crowded value.
FOUND = "kind int, key long, tie long, start long, stop long, value long"


def _send(texts: DataFrame, shards: int, width: int) -> DataFrame:
    """Runs by shard, packed; shard -1 - s: of runs that are copies already, any shard s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def block() -> Iterator[pa.RecordBatch]:
            keys, ties, value, h, doc, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            rank = np.empty(len(keys), np.int64)
            rank[np.lexsort((ties, keys))] = np.arange(len(keys))
            by = np.argsort(rank[doc], kind="stable")
            value, h, doc, start, n = value[by], h[by], doc[by], start[by], n[by]
            order, same = _again(value, h)
            copies = order[same]
            shard = (value % _U(shards)).astype(np.int64)
            shard[copies] = -1 - shard[copies]
            by = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[by])) + 1
            rows = [[] for _ in range(8)]
            for part in np.split(by, cuts) if len(by) else []:
                own, at = np.unique(doc[part], return_inverse=True)
                lists = [keys[own], ties[own], value[part], h[part], at.astype(np.int32), start[part].astype(np.int32), n[part].astype(np.int32)]
                for column, x in zip(rows, [shard[part[0]], *[x.tobytes() for x in lists]], strict=True):
                    column.append(x)
            types = [pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=[c.split()[0] for c in SENT.split(", ")])

        for batch in batches:
            for part in bytetext.slices(batch, 2):
                data, offsets = bytetext.buffers(part.column(2))
                value, h, row, start, n = runs_of(data, offsets, width)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), value, h, row + docs, start, n))
                size, docs = size + len(data), docs + part.num_rows
                if size >= BLOCK:
                    yield from block()
                    held, size, docs = [], 0, 0
        if held:
            yield from block()

    return texts.mapInArrow(run, SENT)


class _Files:
    """Runs of one shard, in memory or, beyond HELD, in files by their hashes, which all go with the object."""

    PARTS = 64

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.n, self.files = 0, None

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.n += len(rows)
        if self.n > HELD:
            self.files = self.files or [tempfile.TemporaryFile() for _ in range(self.PARTS)]
            rows = np.concatenate(self.held)
            part = (rows["hash"] >> _U(58)).astype(np.int64)
            for p in range(self.PARTS):
                self.files[p].write(rows[part == p].tobytes())
            self.held, self.n = [], 0

    def parts(self) -> Iterator[np.ndarray]:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, _RUN)
        if self.files is None:
            yield rest
            return
        part = (rest["hash"] >> _U(58)).astype(np.int64)
        for p, f in enumerate(self.files):
            f.seek(0)
            yield np.concatenate([np.frombuffer(f.read(), _RUN), rest[part == p]])


_RUN = np.dtype([("value", _U), ("hash", _U), ("key", np.int64), ("tie", np.int64), ("start", np.int32), ("n", np.int32)])


def _settled(sent: DataFrame, width: int) -> DataFrame:
    """FOUND rows of all shards: copies of whole runs, and the first runs of hashes that have several. sent: by shard."""

    def found(kind: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        stop = r["start"].astype(np.int64) + np.abs(r["n"]) + np.where(kind == 0, width - 1, 0)
        cols = [kind.astype(np.int32), r["key"], r["tie"], r["start"].astype(np.int64), stop, r["value"].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["kind", "key", "tie", "start", "stop", "value"])

    def shard(files: _Files) -> Iterator[pa.RecordBatch]:
        firsts = []
        for rows in files.parts():
            rows = rows[np.lexsort((rows["start"], rows["tie"], rows["key"], rows["hash"], rows["value"]))]
            same = np.zeros(len(rows), bool)
            same[1:] = (rows["value"][1:] == rows["value"][:-1]) & (rows["hash"][1:] == rows["hash"][:-1])
            # Rows of one document with one text say the same twice.
            twice = np.append(False, same[1:] & (rows["key"][1:] == rows["key"][:-1]) & (rows["tie"][1:] == rows["tie"][:-1]) & (rows["start"][1:] == rows["start"][:-1]))
            yield found(np.zeros(int((same & ~twice).sum())), rows[same & ~twice])
            firsts.append(rows[~same])
        if len(firsts) > 1:
            values, counts = _merged([np.unique(f["value"], return_counts=True) for f in firsts])
        for rows in firsts:
            if len(firsts) == 1:
                _, at, counts = np.unique(rows["value"], return_inverse=True, return_counts=True)
            else:
                at = np.searchsorted(values, rows["value"])
            n = counts[at]
            look = (n > 1) | (rows["n"] < 0)
            yield found(np.where(n[look] > CROWD, 2, 1), rows[look])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files = None, _Files()
        for batch in batches:
            for i in range(batch.num_rows):
                s, keys, ties, value, h, doc, start, n = (batch.column(c)[i].as_py() for c in range(8))
                at = np.frombuffer(doc, np.int32)
                rows = np.empty(len(at), _RUN)
                rows["key"], rows["tie"] = np.frombuffer(keys, np.int64)[at], np.frombuffer(ties, np.int64)[at]
                rows["value"], rows["hash"] = np.frombuffer(value, _U), np.frombuffer(h, _U)
                rows["start"], rows["n"] = np.frombuffer(start, np.int32), np.frombuffer(n, np.int32)
                if s < 0:
                    yield found(np.zeros(len(rows)), rows)
                    continue
                if s != now and now is not None:
                    yield from shard(files)
                    files = _Files()
                now = s
                files.add(rows)
        if now is not None:
            yield from shard(files)

    return sent.mapInArrow(run, FOUND)


def _merged(each: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """values and their summed counts."""
    values, at = np.unique(np.concatenate([e[0] for e in each]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([e[1] for e in each])).astype(np.int64)


FETCHED = "shard int, key long, tie long, start int, n int, bytes binary"


def _fetch(wanted: DataFrame, texts: DataFrame, shards: int, width: int) -> DataFrame:
    """The bytes of the wanted runs, with the shard of their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bytetext.slices(whole, 2):
                data, offsets = bytetext.buffers(batch.column(2))
                lists = batch.column(3)
                flat = lists.flatten()
                start, stop, value = (flat.field(c).to_numpy() for c in range(3))
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy().astype(np.int64)))
                n = stop - start
                size = n + width - 1
                ends = np.cumsum(size)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[row] + start - (ends - size), size)
                blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data[at])])
                cols = [pa.array((value.view(_U) % _U(shards)).astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), blob]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in FETCHED.split(", ")])

    by_doc = wanted.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "stop", "value")).alias("runs"))
    rows = texts.select("key", "tie", "text").join(by_doc, ["key", "tie"])
    return rows.select("key", "tie", "text", "runs").mapInArrow(run, FETCHED)


def _sorted(fetched: DataFrame, width: int, limit: int = induced.LIMIT) -> DataFrame:
    """(key, tie, start, stop) of windows that come again in the runs of a shard, neighbours joined."""

    def shard(group: pa.Table) -> pa.Table:
        key, tie, start, n = (group.column(c).to_numpy() for c in ("key", "tie", "start", "n"))
        order = np.lexsort((start, tie, key))
        key, tie, start, n = key[order], tie[order], start[order], n[order]
        data, _ = bytetext.buffers(group.column("bytes").take(pa.array(order)).combine_chunks().cast(pa.large_binary()))
        size = n + width - 1
        first = np.cumsum(size, dtype=np.int64) - size
        window = np.zeros(len(data) + 1, np.int8)
        window[first] += 1
        np.add.at(window, first + n, -1)
        window = np.cumsum(window, dtype=np.int8)[:-1] > 0
        places, common = induced.suffix_order(data, width, limit)
        kept = np.flatnonzero(window[places])
        if len(kept):
            places = places[kept]
            fresh = np.minimum.reduceat(common, np.append(0, kept[:-1] + 1)) < width  # the least since the last window
            fresh[0] = True
            groups = np.flatnonzero(fresh)
            least = np.minimum.reduceat(places, groups)
            places = np.sort(places[places != np.repeat(least, np.diff(np.append(groups, len(places))))])
        else:
            places = places[:0]
        of = np.searchsorted(first, places, "right") - 1
        at = start[of] + places - first[of]
        joined = np.ones(len(at), bool)
        joined[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
        begins = np.flatnonzero(joined)
        lasts = np.append(begins[1:], len(at)) - 1
        lasts = lasts[lasts >= 0]
        cols = [key[of[begins]], tie[of[begins]], at[begins].astype(np.int64), at[lasts].astype(np.int64) + width]
        return pa.table([pa.array(c) for c in cols], names=["key", "tie", "start", "stop"])

    return fetched.groupBy("shard").applyInArrow(shard, "key long, tie long, start long, stop long")


def _crowded(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(key, tie, start, stop) of windows that come again, of runs whose value has too many different ones for a shard."""
    rows = texts.select("key", "tie", F.encode("text", "UTF-8").alias("bytes")).join(wanted.select("key", "tie", "start", "stop"), ["key", "tie"])
    window = F.substring(F.col("bytes"), F.col("at").cast("int") + 1, F.lit(width))
    each = rows.select("key", "tie", "bytes", F.explode(F.sequence("start", F.col("stop") - 1)).alias("at")).select(F.sha2(window, 256).alias("h"), F.struct("key", "tie", "at").alias("w"))
    several = each.groupBy("h").agg(F.min("w").alias("least"), F.max("w").alias("most")).where("least <> most").select("h", "least")
    again = each.join(several, "h").where("w <> least")
    return again.select("w.key", "w.tie", F.col("w.at").alias("start"), (F.col("w.at") + width).alias("stop"))


KEPT = "doc_id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary"


def _cut(marked: DataFrame) -> DataFrame:
    """KEPT rows of (doc_id, text, spans, copy); of a copy everything goes that can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bytetext.slices(whole, 1, 1 << 23):
                data, offsets = bytetext.buffers(batch.column(1))
                lists = batch.column(2)
                flat = lists.flatten()
                per = np.diff(lists.offsets.to_numpy().astype(np.int64))
                row = np.repeat(np.arange(batch.num_rows), per)
                begin, end = flat.field(0).to_numpy() + offsets[row], flat.field(1).to_numpy() + offsets[row]
                order = np.argsort(begin, kind="stable")
                begin, end, row = begin[order], np.maximum.accumulate(end[order]) if len(end) else end, row[order]
                fresh = np.ones(len(begin), bool)
                fresh[1:] = (begin[1:] > end[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(begin)) - 1 if len(first) else first
                begin, end, row = begin[first], end[last], row[first]
                mark = np.zeros(len(data) + 1, np.int32)
                np.add.at(mark, begin, 1)
                np.add.at(mark, end, -1)
                stays = np.cumsum(mark[:-1]) == 0
                left = np.append(0, np.cumsum(stays))[offsets]
                spans = pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], names=["start", "stop"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)), spans)
                kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[stays])])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), lists, kept], names=["doc_id", "n_bytes", "removed", "kept"])

    return marked.mapInArrow(run, KEPT)


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed and kept of every row: the text as UTF-8 bytes without those that are covered by a string
    of width bytes that also starts earlier, and the spans that are gone.

    Earlier is in a document of smaller doc_id, or before in the same one. Rows of one doc_id are documents of their own,
    by the hash of their texts; of rows with equal texts too, one is the first. Rows without doc_id come last. A null text
    is empty; a text of fewer than width bytes stays whole. What is left of a text need not be UTF-8. An empty table gives
    no rows; other columns are not read.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    repeats = bool(ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key, tie = F.coalesce(F.col("doc_id"), F.lit(LAST)), F.xxhash64("text") if repeats else F.lit(0).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(key.alias("key"), tie.alias("tie"), "doc_id", "text")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SHARD))
    sent = _send(texts.select("key", "tie", "text"), shards, width)
    slot = F.when(F.col("shard") < 0, -1 - F.col("shard")).otherwise(F.col("shard"))
    found = settle(_settled(sent.repartition(shards, slot).sortWithinPartitions("shard"), width))
    wanted = found.where("kind = 1")
    fetched = wanted.agg(F.coalesce(F.sum(F.col("stop") - F.col("start") + width), F.lit(0))).first()[0]
    marks = found.where("kind = 0").select("key", "tie", "start", "stop")
    if fetched:
        marks = marks.union(settle(_sorted(_fetch(wanted, texts, max(shards, math.ceil(fetched / SORTED)), width), width)))
    if found.where("kind = 2").head(1):
        marks = marks.union(settle(_crowded(found.where("kind = 2"), texts, width)))
    spans = marks.groupBy("key", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = texts.join(spans, ["key", "tie"], "left").select("key", "tie", "doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"))
    if repeats:
        rows = _with_copies(rows, texts, width)
    return _cut(rows.select("doc_id", "text", "spans"))


def _with_copies(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """rows, where of those with one doc_id and one text all but one are cut whole."""
    equal = ["key", "tie"]
    copies = settle(texts.groupBy(*equal).count().where("count > 1").select(*equal, F.col("count").alias("n")))
    one = rows.join(copies, equal, "left_anti")
    some = rows.join(copies, equal).groupBy(*equal).agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.min("spans").alias("spans"))
    size = F.octet_length("text").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))
    each = some.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return one.select("doc_id", "text", "spans").union(each.select("doc_id", "text", F.when((F.col("copy") > 1) & (size >= width), whole).otherwise(F.col("spans"))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier in the corpus."""
    done = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
