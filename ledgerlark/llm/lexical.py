"""Ranked lexical search as a blocked sparse matrix product.

Rows of the left matrix are items, with the multiplicity of each of their terms; rows of the right one are terms, with
the 64-bit impact that each has in each document. The right matrix is cut into blocks of documents. A row of the product
is merged by Gustavson's rule: the rows of the right matrix that the item's terms name are added up, one after the other,
in a dense row of the block's width. Only the best of each item leave a block, a task and the last merge.

Documents are read once for each group of items; what leaves that pass are the terms that some item of the group has.
Terms are told apart by 64-bit hashes of their lower-cased bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm import bytetext
from ledgerlark.llm.common import discard, keyed_text, settle, table

#: A term is a run of digits, ASCII letters and characters beyond ASCII.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Documents and entries of a block; item terms of a group, which bounds what is broadcast.
BLOCK_DOCS, BLOCK_ENTRIES, GROUP_TERMS = 4096, 1 << 20, 1 << 20
BEST = 10

POSTINGS = "n_docs long, n_terms long, ids binary, lengths binary, starts binary, terms binary, counts binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (its hash) and n, how often the item has it. Rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.slices(batch, 1):
                w = bytetext.Words(*bytetext.buffers(part.column(1)), NO_TERM)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(w.doc))), pa.array(w.hash.view(np.int64))], names=["item_id", "term"])

    each = items.where("item_id is not null").mapInArrow(run, "item_id long, term long")
    return each.groupBy("item_id", "term").agg(F.count("*").alias("n"))


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """Blocks of documents: their ids, lengths in terms, and (term, count) of the vocabulary's terms in each. n_docs and
    n_terms count the documents with a term and their terms; documents without a known term, or without id, are counted only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held: list[tuple[np.ndarray, ...]] = []
        n_docs = n_terms = 0

        def block() -> pa.RecordBatch:
            ids, lengths, per_doc, terms, counts = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held, strict=True) if held else [()] * 5))
            starts = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
            packed = [x.tobytes() for x in (ids.astype(np.int64), lengths.astype(np.int64), starts, terms.astype(np.int32), counts.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms]), *[pa.array([x], pa.binary()) for x in packed]], names=["n_docs", "n_terms", "ids", "lengths", "starts", "terms", "counts"])

        for batch in batches:
            for part in bytetext.slices(batch, 1):
                w = bytetext.Words(*bytetext.buffers(part.column(1)), NO_TERM)
                lengths = np.diff(w.doc)
                n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + len(w.hash)
                if not len(known) or not len(w.hash):
                    continue
                term = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = np.flatnonzero(known[term] == w.hash)
                doc = np.searchsorted(w.doc, hit, "right") - 1
                named = ~part.column(0).is_null().to_numpy(zero_copy_only=False)
                hit, doc = hit[named[doc]], doc[named[doc]]
                key, counts = np.unique(doc * len(known) + term[hit], return_counts=True)
                doc, term = key // len(known), key % len(known)
                rows, per_doc = np.unique(doc, return_counts=True)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                held.append((ids[rows], lengths[rows], per_doc, term, counts))
                if sum(len(h[0]) for h in held) >= BLOCK_DOCS or sum(len(h[3]) for h in held) >= BLOCK_ENTRIES:
                    yield block()
                    held, n_docs, n_terms = [], 0, 0
        yield block()

    return docs.mapInArrow(run, POSTINGS)


def _totals(postings: DataFrame, n_known: int) -> DataFrame:
    """(term, n): in how many documents each term is; term -1 has the number of documents and -2 that of all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_known + 2, np.int64)
        for batch in batches:
            for n_docs, n_terms, terms in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                sums[:2] += (n_terms, n_docs)
                sums[2:] += np.bincount(np.frombuffer(terms, np.int32), minlength=n_known)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at - 2), pa.array(sums[at])], names=["term", "n"])

    return postings.select("n_docs", "n_terms", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _best(held: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, held ones included; of equal scores those of the smaller ids."""
    scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
    if len(scores) > 4 * k:  # ties with the last one all stay
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _product(postings: DataFrame, left, k: int) -> DataFrame:
    """item_id, doc_id and score of the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, terms, times, weight, n_all, l_all = left.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in (0, 1))
                at, term, count = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in (2, 3, 4))
                doc = np.repeat(np.arange(len(ids)), np.diff(at))
                m = 100 - 90 + (90 * lengths * n_all) // max(l_all, 1)
                tf = count.astype(np.int64)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                order = np.argsort(term, kind="stable")  # the rows of the right matrix: by term, then document
                doc, impact = doc[order], impact[order]
                rows = np.searchsorted(term[order], np.arange(len(weight) + 1))
                for i in range(len(items)):
                    merged = np.zeros(len(ids), np.int64)
                    for t, n in zip(terms[starts[i] : starts[i + 1]], times[starts[i] : starts[i + 1]], strict=True):
                        a, b = rows[t], rows[t + 1]
                        merged[doc[a:b]] += n * impact[a:b]  # a document is in a row once
                    least = best[i][0][-1] if len(best[i][0]) == k else 1
                    found = np.flatnonzero(merged >= max(least, 1))
                    if len(found):
                        best[i] = _best(best[i], merged[found], ids[found], k)
        n = [len(b[0]) for b in best]
        if sum(n):
            out = [pa.array(np.repeat(items, n)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))]
            yield pa.RecordBatch.from_arrays(out, names=["item_id", "doc_id", "score"])

    return postings.select("ids", "lengths", "starts", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def _left(entries: np.ndarray, multiplicity: bool) -> tuple[np.ndarray, ...]:
    """entries (item_id, term, n) as items, row starts, term numbers, multiplicities, and the terms' hashes in order."""
    known = np.unique(entries[:, 1].view(np.uint64))
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    items, first = np.unique(entries[:, 0], return_index=True)
    times = entries[:, 2] if multiplicity else np.ones(len(entries), np.int64)
    return items, np.append(first, len(entries)), np.searchsorted(known, entries[:, 1].view(np.uint64)), times, known


def search(docs: DataFrame, items: DataFrame, k: int = BEST, multiplicity: bool = False, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: the k documents of each item with the highest scores above 0.

    A term of df documents weighs floor(1000 ln((2N + 2) / (2 df + 1))), N counting the documents with a term. Where it
    occurs tf times in a document of n terms its impact is weight * (10^9 tf div (1000 tf + 8 m)) with m = 10 + 90 n N
    div L, L counting all terms. An item's score is the sum over its terms, once each or as often as it has them.
    Equal scores are ranked by doc_id.

    Null and empty texts have no terms. Rows of one doc_id are documents of their own; a document without id counts in
    N, L and df and is not ranked. Rows of one item_id are one item; an item without id, or without terms, has no rows.
    Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    corpus = keyed_text(docs, doc_id, text)
    wanted = settle(item_terms(keyed_text(items, item_id, item_text).withColumnRenamed("doc_id", "item_id")))
    groups = max(1, math.ceil(wanted.count() / GROUP_TERMS))
    parts = []
    for g in range(groups):  # each broadcasts about GROUP_TERMS item terms
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow()
        entries = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("item_id", "term", "n")], axis=1).reshape(-1, 3)
        names, starts, terms, times, known = _left(entries, multiplicity)
        postings = settle(_postings(corpus, spark.sparkContext.broadcast(known)))
        counts = {r["term"]: r["n"] for r in _totals(postings, len(known)).collect()}  # a row for each term of the group
        n_all, l_all = counts.get(-1, 0), counts.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(known))], np.int64)
        parts.append(settle(_product(postings, spark.sparkContext.broadcast((names, starts, terms, times, weight, n_all, l_all)), k)))
        discard(postings)
    discard(wanted)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.select("item_id", F.row_number().over(order).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that rank highest for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL for op11_lexical_search.
ORACLE_SQL = rf"""
with d as materialized (select doc_id, {_TERMS} as ts from documents), i as materialized (select distinct item_id, unnest({_TERMS}) as term from benchmark where item_id is not null
), g as (select count(*)::bigint as n_all, sum(len(ts))::bigint as l_all from d where len(ts) > 0
), v as materialized (select distinct term from i), t as materialized (select doc_id, unnest(ts) as term from d
), p as materialized (select doc_id, term, count(*)::bigint as tf from t semi join v using (term) group by all
), w as (select term, floor(1000 * ln((2 * any_value(n_all) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, g group by term
), s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_all) // l_all)))))::bigint as score from i join p using (term) join w using (term) join (select doc_id, len(ts)::bigint as n from d) using (doc_id), g group by all
)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0 and doc_id is not null) where rank <= 10
"""
