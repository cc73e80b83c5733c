"""Benchmark decontamination by latent semantic retrieval, confirmed word by word.

1. Document frequencies of hashed words over all documents give inverse document frequencies.
2. Benchmark items are cut into passages. A randomised SVD of their TF-IDF matrix, whose products are summed over the
   partitions of the passages, gives the latent space. Only the Gram matrix and the range (rank x benchmark words)
   reach the driver.
3. Every window of every document is compared. Term frequencies enter as square roots, so squared norms are sums over
   tokens, and running sums bound a window's similarity to any passage: by the share of its norm that benchmark words
   hold, and by what its rare and its frequent benchmark words can add at most. For those left, the lists of passages
   in which a rare word has a value give the rare part for each passage, but for what small values can add at most. The
   passages are taken as the latent space has them, so windows that stay below the threshold by these bounds would not
   reach it in that space either; the others are projected.
4. Candidates are confirmed by the longest common subsequence with the item, weighted by inverse document frequency,
   and, for paraphrases, by whether the item's answer (its last sentence) is in the document too.

The benchmark is the query set. It is taken in blocks of bounded size, and as many groups of its passages as fit into
PASS_BYTES are compared with all documents in one pass. Items of a few words are searched in short windows too, of which
they can be a large enough part; items of very many words are several, with one answer and one hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import bytetext
from ledgerlark.llm.common import keyed_text, table

DIM_BITS = 17
#: Words of a passage and of a window, and the steps between them.
PASSAGE, PASSAGE_STEP, WINDOW, WINDOW_STEP = 24, 12, 24, 6
#: Items of fewer words than SHORT are searched in windows of SHORT_WINDOW words too.
SHORT, SHORT_WINDOW, SHORT_STEP = 10, 6, 1
#: Passages that share a latent space, at most; it has as few dimensions as leave every passage this share of its
#: squared length. SPARE, POWERS: spare columns of the random range, and its power iterations.
SPACE, ENERGY, SPARE, POWERS = 1024, 0.9, 16, 1
#: Least latent similarity of a candidate; weighted LCS that confirms it alone, or with the answer.
COSINE, LCS, LCS_WITH_ANSWER, ANSWER = 0.4, 0.7, 0.5, 0.8
#: Words of a smaller weight are frequent ones; rare words of a smaller value in a passage are bounded, not listed. SLACK:
#: what rounding may take from a similarity.
FREQUENT, LISTED, SLACK = 4.0, 0.03, 1e-4
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of the groups that are searched in one pass over the documents; one group alone may have more.
PASS_BYTES = 128 << 20
SLICE = 192
HITS = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double,first_word:bigint>>"


#: Words are runs of letters and digits; marks in and around them do not count.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(column: pa.Array) -> bytetext.Words:
    """Words in lower case, in any script."""
    return bytetext.Words(*bytetext.buffers(pc.utf8_lower(column)), _MARK)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DIM_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each word bucket occurs, and the number of documents; an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DIM_BITS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                w = _words(batch.slice(at, SLICE).column(0))
                rows = len(w.doc) - 1
                own = np.unique(np.repeat(np.arange(rows), np.diff(w.doc)) << DIM_BITS | buckets(w.hash))
                total += np.bincount(own & ((1 << DIM_BITS) - 1), minlength=len(total))
                n += rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["bucket", "n"])

    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    got = text.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    where, count = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << DIM_BITS, np.int64)
    df[where[where >= 0]] = count[where >= 0]
    return df, int(count[where < 0].sum())


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.01)


@dataclass
class Index:
    """One group of benchmark items. slot: bucket -> first place in own, or -1; own: the items' words by bucket and
    hash, the rows of basis; latent: the passages in the latent space, of unit length; lists: for each place, where its
    list begins, then the passages in which it has a value and these values, rare words only, and the passages being
    those of latent carried back to words; frequent, small: the norms of their frequent and of their unlisted rare
    words; item: the place of each passage's item; items: place -> hashes of its words and of its
    answer; ids: of the items; parts: whether each is a part of an item."""

    idf: np.ndarray
    slot: np.ndarray
    own: np.ndarray
    frequent: np.ndarray
    small: np.ndarray
    lists: tuple[np.ndarray, np.ndarray, np.ndarray]
    basis: np.ndarray
    latent: np.ndarray
    item: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    ids: list[int]
    parts: list[bool]

    @property
    def size(self) -> int:
        """Bytes of its arrays."""
        return self.basis.nbytes + self.latent.nbytes + self.idf.nbytes + self.slot.nbytes + sum(x.nbytes for x in self.lists)


def _passages(n: int) -> list[tuple[int, int]]:
    if n <= PASSAGE:
        return [(0, n)]
    starts = [*range(0, n - PASSAGE, PASSAGE_STEP), n - PASSAGE]
    return [(s, s + PASSAGE) for s in starts]


def _answer(text: str) -> str:
    parts = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    return parts[-1] if parts else ""


def _hashes(texts: list[str]) -> list[np.ndarray]:
    w = _words(pa.array(texts, pa.string()))
    return [w.hash[a:b] for a, b in zip(w.doc[:-1], w.doc[1:], strict=True)]


def _places(own: np.ndarray, slot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each word in own, or -1. Most words end at the bucket's slot."""
    first = slot[buckets(hashes)]
    out = np.full(len(hashes), -1, np.int32)
    some = np.flatnonzero(first >= 0)
    at = np.searchsorted(own, hashes[some])
    at[at == len(own)] = 0
    same = own[at] == hashes[some]
    out[some[same]] = at[same]
    return out


def _vectors(passages: list[np.ndarray], own: np.ndarray, slot: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length over the benchmark's own words."""
    out = np.zeros((len(passages), len(own)), np.float32)
    for i, p in enumerate(passages):
        np.add.at(out[i], _places(own, slot, p), idf[buckets(p)] ** 2)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _summed(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of make(passages), a matrix of the given shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                blobs = batch.slice(at, 2048).column(0).to_pylist()
                total += make([np.frombuffer(b, np.uint64) for b in blobs])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "sums"])

    out = np.zeros(shape, np.float64)
    for r in rows.select("words").mapInArrow(run, "row int, sums binary").toLocalIterator():
        out[r["row"]] += np.frombuffer(r["sums"], np.float32)
    return out


def latent_basis(rows: DataFrame, own: np.ndarray, slot: np.ndarray, idf: np.ndarray, rank: int) -> np.ndarray:
    """The first rank right singular vectors (width x rank), in order, of the TF-IDF matrix of the passages in rows.words."""
    width = len(own)
    size = min(rank + SPARE, width)
    start = np.random.default_rng(7).standard_normal((width, size)).astype(np.float32)

    def pull(basis: np.ndarray) -> np.ndarray:
        """A^T A basis, transposed."""
        return _summed(rows, lambda p: (lambda a: (a @ basis).T @ a)(_vectors(p, own, slot, idf)), (size, width))

    basis = start
    for _ in range(POWERS + 1):
        basis = np.linalg.qr(pull(basis).T)[0].astype(np.float32)
    small = pull(basis) @ basis  # (A basis)^T (A basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = [i for i in np.argsort(values)[::-1][:rank] if values[i] > 1e-6]
    return (basis @ vectors[:, keep]).astype(np.float32)


def spaces(items: list[tuple[int, str]]) -> list[list[tuple[int, str, str, bool]]]:
    """The items, each with its answer and whether it is a part of one, in groups of at most SPACE passages; an item with more passages is cut into
    overlapping parts."""
    most = (SPACE - 1) * PASSAGE_STEP
    parts: list[tuple[int, str, str, bool]] = []
    for i, text in items:
        words = list(re.finditer(r"[^\W_]+", text)) if len(text) > most else []
        if len(words) > most:
            for at in range(0, len(words) - PASSAGE, most - PASSAGE):
                own = words[at : at + most]
                parts.append((i, text[own[0].start() : own[-1].end()], _answer(text), True))
        else:
            parts.append((i, text, _answer(text), False))
    out: list[list[tuple[int, str, str, bool]]] = [[]]
    held = 0
    for part, w in zip(parts, _hashes([x[1] for x in parts]), strict=True):
        more = len(_passages(len(w)))
        if out[-1] and held + more > SPACE:
            out.append([])
            held = 0
        out[-1].append(part)
        held += more
    return out


def build(spark: SparkSession, items: list[tuple], idf: np.ndarray) -> Index | None:
    """The index of one group of items (id and text, or what spaces() gives); None if none has a word."""
    words = _hashes([x[1] for x in items])
    kept = [(x[0], x[2] if len(x) > 2 else _answer(x[1]), w, len(x) > 2 and x[3]) for x, w in zip(items, words, strict=True) if len(w)]
    if not kept:
        return None
    answers = _hashes([x[1] for x in kept])
    parts = [(k, w[a:b]) for k, (_, _, w, _) in enumerate(kept) for a, b in _passages(len(w))]
    own = np.unique(np.concatenate([x[2] for x in kept]))  # in the order of their buckets, the hashes' first bits
    slot = np.full(1 << DIM_BITS, -1, np.int32)
    slot[buckets(own)[::-1]] = np.arange(len(own))[::-1]
    rows = spark.createDataFrame([(bytearray(p.tobytes()),) for _, p in parts], "words binary").repartition(max(1, min(8, len(parts) // 2000)))
    vectors = _vectors([p for _, p in parts], own, slot, idf)
    basis = latent_basis(rows, own, slot, idf, len(parts))
    latent = vectors @ basis
    left = np.minimum.accumulate(np.cumsum(latent[:, ::-1] ** 2, axis=1)[:, ::-1], axis=1)  # in the dimensions from each on
    enough = ((latent**2).sum(axis=1, keepdims=True) - left >= ENERGY).all(axis=0)
    rank = int(enough.argmax()) if enough.any() else basis.shape[1]
    basis, latent = basis[:, :rank], latent[:, :rank]
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    vectors = latent @ basis.T
    often = idf[buckets(own)] < FREQUENT
    frequent = np.linalg.norm(vectors[:, often], axis=1).astype(np.float64)
    vectors[:, often] = 0
    word, passage = np.nonzero((np.abs(vectors) >= LISTED).T)
    lists = (np.searchsorted(word, np.arange(len(own) + 1)), passage, vectors[passage, word].astype(np.float64))
    vectors[passage, word] = 0
    small = np.linalg.norm(vectors, axis=1).astype(np.float64)
    return Index(idf, slot, own, frequent, small, lists, basis, latent.astype(np.float32), np.array([k for k, _ in parts]), [(x[2], a) for x, a in zip(kept, answers, strict=True)], [x[0] for x in kept], [x[3] for x in kept])


def weighted_lcs(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Greatest weight of a common subsequence of a and b; w: weights of a's words."""
    best = np.zeros(len(b) + 1)
    for x, weight in zip(a, w, strict=True):
        took = np.where(b == x, best[:-1] + weight, 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], took))
    return float(best[-1])


def _confirm(index: Index, words: np.ndarray, item: int, at: int) -> tuple[float, float]:
    """Weighted share of the best-matching passage length of the item that the region holds in order, and of its answer."""
    own, answer = index.items[item]
    idf = index.idf[buckets(own)]
    region = words[max(0, at - len(own)) : at + WINDOW + len(own)]
    best = 0.0
    for a, b in _passages(len(own)):
        whole = float(idf[a:b].sum())
        if whole > 0:
            best = max(best, weighted_lcs(own[a:b], region, idf[a:b]) / whole)
    rare = np.unique(answer)
    weight = index.idf[buckets(rare)]
    said = float(weight[np.isin(rare, region)].sum() / weight.sum()) if len(rare) and weight.sum() > 0 else 0.0
    return best, said


def _search(index: Index, w: bytetext.Words) -> list[list[dict]]:
    found: list[list[dict]] = [[] for _ in range(len(w.doc) - 1)]
    if len(w.hash):
        _in_windows(index, w, WINDOW, WINDOW_STEP, found)
        if min(len(own) for own, _ in index.items) < SHORT:
            _in_windows(index, w, SHORT_WINDOW, SHORT_STEP, found)
    return found


def _in_windows(index: Index, w: bytetext.Words, window: int, step: int, found: list[list[dict]]) -> None:
    """Adds to found what windows of so many words find, but items that it has already."""
    n = len(w.doc) - 1
    b = buckets(w.hash)
    weight = index.idf[b].astype(np.float64)
    place = _places(index.own, index.slot, w.hash)
    sq = weight**2
    ours, often = place >= 0, weight < FREQUENT
    all_mass, rare_mass, often_mass = (np.concatenate([[0], np.cumsum(v)]) for v in (sq, np.where(ours & ~often, sq, 0), np.where(ours & often, sq, 0)))
    counts = np.diff(w.doc)
    per = np.where(counts > 0, 1 + (np.maximum(counts - window, 0) + step - 1) // step, 0)
    doc = np.repeat(np.arange(n), per)
    start = w.doc[doc] + (np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)) * step
    start = np.maximum(np.minimum(start, w.doc[doc + 1] - window), w.doc[doc])
    stop = np.minimum(start + window, w.doc[doc + 1])
    mass = lambda sums: np.maximum(sums[stop] - sums[start], 0)
    squared, rare, common = mass(all_mass), mass(rare_mass), mass(often_mass)
    most, most_small = index.frequent.max(), index.small.max()
    bound = np.minimum(np.sqrt(rare + common), np.sqrt(rare) + most * np.sqrt(common))
    likely = np.flatnonzero(bound >= (COSINE - SLACK) * np.sqrt(squared))
    for k0 in range(0, len(likely), 2048):
        some = likely[k0 : k0 + 2048]
        sizes = stop[some] - start[some]
        rows = np.repeat(np.arange(len(some)), sizes)
        where = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[some], sizes)
        kept = ours[where]
        if not kept.any():
            continue
        pair, inverse = np.unique(rows[kept] * len(index.own) + place[where[kept]], return_inverse=True)
        value = np.sqrt(np.bincount(inverse, sq[where[kept]]))
        owner, word = pair // len(index.own), pair % len(index.own)
        norm = np.sqrt(squared[some])
        # The listed part of the similarity with each passage, and the most that other words can add to it.
        begin, passage, there = index.lists
        size = begin[word + 1] - begin[word]
        each = np.repeat(np.arange(len(word)), size)
        at = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + begin[word[each]]
        meet, part = np.unique(owner[each] * len(index.latent) + passage[at], return_inverse=True)
        dot = np.bincount(part, value[each] * there[at], len(meet))
        win, with_passage = meet // len(index.latent), meet % len(index.latent)
        share, rest = np.sqrt(common[some]), np.sqrt(rare[some])
        near = np.zeros(len(some), bool)
        near[win[dot + share[win] * index.frequent[with_passage] + rest[win] * index.small[with_passage] >= (COSINE - SLACK) * norm[win]]] = True
        near |= share * most + rest * most_small >= (COSINE - SLACK) * norm
        use = near[owner]
        if not use.any():
            continue
        owner, word, value = owner[use], word[use], value[use]
        o, first = np.unique(owner, return_index=True)
        latent = np.zeros((len(some), index.basis.shape[1]), np.float32)
        latent[o] = np.add.reduceat(index.basis[word] * value[:, None].astype(np.float32), first, axis=0)
        cosine = latent[o] @ index.latent.T / np.maximum(norm[o, None], 1e-9)
        r, p = np.nonzero(cosine >= COSINE)
        for i, j in sorted(zip(r, p, strict=True), key=lambda x: -cosine[x]):
            win = some[o[i]]
            d, item = int(doc[win]), int(index.item[j])
            if any(x["_k"] == item for x in found[d]):
                continue
            lcs, answer = _confirm(index, w.hash[w.doc[d] : w.doc[d + 1]], item, int(start[win] - w.doc[d]))
            if lcs >= LCS or (lcs >= LCS_WITH_ANSWER and answer >= ANSWER):
                found[d].append({"_k": item, "item_id": index.ids[item], "cosine": float(cosine[i, j]), "lcs": lcs, "answer": answer, "first_word": int(start[win] - w.doc[d])})


def matches(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", out_col: str = "hits") -> DataFrame:
    """The given columns of every row (all of them if not given) and out_col: the benchmark items found in its text.

    A null or empty text, and an item without words, has no hits; repeated rows have theirs each; equal items are
    each reported. An empty benchmark gives no hits, an empty table no rows. Column names of docs may be any.
    """
    spark = docs.sparkSession
    columns = docs.columns if columns is None else columns
    df, n = document_frequencies(docs, text_col)
    idf = weights(df, n)
    items = keyed_text(benchmark, item_col, item_text).where("doc_id is not null").withColumnRenamed("doc_id", "item_id")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    names = [f"c{i}" for i in range(len(columns))]
    out = docs.select(*[F.col(c).alias(x) for c, x in zip(columns, names, strict=True)], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("searched"), F.array().cast(HITS).alias("hits"))
    indexes: list[Index] = []
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()  # about BLOCK_BYTES of text
        for group in spaces(sorted((r["item_id"], r["text"]) for r in some)):
            index = build(spark, group, idf)
            if index is not None:
                if indexes and sum(x.size for x in indexes) + index.size > PASS_BYTES:
                    out, indexes = _with_hits(out, indexes), []
                indexes.append(index)
    if indexes:
        out = _with_hits(out, indexes)
    return out.select(*[F.col(x).alias(c) for c, x in zip(columns, names, strict=True)], F.col("hits").alias(out_col))


def _with_hits(rows: DataFrame, indexes: list[Index]) -> DataFrame:
    """rows with the hits of these groups added; the texts are cut into words once. Parts of one item give one hit."""
    shared = rows.sparkSession.sparkContext.broadcast(indexes)  # bounded by PASS_BYTES, or by SPACE and the words of its passages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                words = _words(part.column(part.num_columns - 2))
                hits = part.column(part.num_columns - 1).to_pylist()
                for index in shared.value:
                    for old, new in zip(hits, _search(index, words), strict=True):
                        for x in new:
                            if not (index.parts[x["_k"]] and any(y["item_id"] == x["item_id"] for y in old)):
                                old.append({k: v for k, v in x.items() if k != "_k"})
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, part.schema.field(part.num_columns - 1).type)], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = matches(docs, table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.where(F.size("hits") > 0).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")
