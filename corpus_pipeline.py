"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it back as the next stage's docs. All stages but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, minhash, packing, pii, quality
from ledgerlark.llm.common import settle, table


def _mark(docs: DataFrame) -> str:
    """A name that no column of the documents has."""
    name = "_mark"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like others."""
    model, mark = quality.train(docs, table(spark, sf_dir, "labels")), _mark(docs)
    return quality.score(docs, model, out_col=mark).where(F.col(mark) >= quality.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8): the one with the smallest doc_id.

    Rows of one doc_id are one document; of those with equal texts one row stays, the one with the smallest hash, and
    those with different texts stay all. Documents without words, and rows without a doc_id, are no copies of anything.
    """
    found, mark = minhash.near_duplicates(docs, size=5), _mark(docs)
    # Written first, so that the joins are planned by true sizes.
    gone = settle(found.where("not kept").select(F.col("doc_id").alias(mark)).distinct())
    again = settle(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias(mark)))
    left = docs.join(gone, docs["doc_id"] == gone[mark], "left_anti")
    several = left.join(again, left["doc_id"] == again[mark], "left_semi")
    one = several.groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(mark)).select(f"{mark}.*")
    return left.join(again, left["doc_id"] == again[mark], "left_anti").unionByName(one)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    mark = _mark(docs)
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), out_col=mark)
    return found.where(F.size(mark) == 0).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of all documents, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmarks),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: SQL can express none of the classifier, the semantic search and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
