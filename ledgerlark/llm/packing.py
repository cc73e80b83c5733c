"""Packing by power-of-two decomposition.

A document of n ids becomes n // capacity pieces of the capacity and one piece for each set bit of the rest,
longest first. A piece is a sequence by itself, of a power-of-two length, in the bucket of that length: no
sequence crosses documents and none needs padding. The operator is one narrow pass over the documents; the
memory of a task is one Arrow batch and the ids of one document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import codec
from ledgerlark.llm.common import keyed_text, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids array<int>"
#: Sequence ids are (partition << SEQ_BITS) + running number; a partition holds fewer pieces than that.
SEQ_BITS = 40


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: full ones, then the binary digits of the rest from the highest."""
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if n % capacity >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its ids unless with_ids is False.

    A null or empty text is a document of only the end id: one piece of length 1. Repeated rows and repeated
    doc_ids are packed separately, each with sequences of its own; a null doc_id stays null. Texts of any length
    are encoded whole. An empty table gives no rows. Other columns are not read. The capacity must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or codec.default_path()
    schema = SCHEMA if with_ids else SCHEMA.rpartition(", ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = codec.load(path)
        seq = TaskContext.get().partitionId() << SEQ_BITS
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, start, length, crc, total, tokens = [], [], [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(codec.ids(encoder, text), np.uint32(end_id)).astype("<u4")
                    raw, pos = memoryview(ids.tobytes()), 0
                    for size in piece_lengths(len(ids), capacity):
                        doc.append(key)
                        start.append(pos)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * pos : 4 * (pos + size)]))
                        total.append(len(ids))
                        if with_ids:
                            tokens.append(ids[pos : pos + size].astype(np.int32))
                        pos += size
                n = len(doc)
                size = np.array(length, dtype=np.int64)
                cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(seq, seq + n, dtype=np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.round(np.log2(size)).astype(np.int32))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    cols.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                seq += n
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens; their ids are digested, not returned."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
