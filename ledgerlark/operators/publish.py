"""Publishing a table: written aside, gated, then renamed to its place, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.errors import EngineError
from ledgerlark.operators import gates


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    fs, path = _path(spark, name)
    return fs.exists(path)


def publish(rows: DataFrame, name: str, checks: Callable[[DataFrame], list[DataFrame]], apply: bool = True) -> DataFrame:
    """The published table, or with apply=False (a dry run) the outcome of the checks; a failed check raises, and nothing
    is left. Checks see the rows as they are written. A table that is there already is not replaced."""
    spark = rows.sparkSession
    aside = f"{name.rstrip('/')}.{uuid.uuid4().hex}"
    if apply and exists(spark, name):
        raise EngineError("ALREADY_PUBLISHED", f"{name} is there already", "name")
    fs, path = _path(spark, aside)
    try:
        rows.write.parquet(aside)
        outcome = gates.enforce(checks(spark.read.parquet(aside)))
        if not apply:
            return spark.createDataFrame(outcome.collect(), outcome.schema)  # a row for each check
        fs.rename(path, _path(spark, name)[1])
    finally:
        fs.delete(path, True)
    if not exists(spark, name):
        raise EngineError("NOT_STORED", f"{name} was not stored", "name")
    return spark.read.parquet(name)
