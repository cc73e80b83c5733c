"""Sources and sinks: Parquet tables, delimited files with a byte-order mark, JSON, and exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.errors import EngineError

MARK = "﻿"


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir. Where that is unset, a folder of this
    machine if all of Spark runs on it; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("NO_SHARED_FOLDER", "set spark.checkpoint.dir to a folder that all machines see", "spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="ledgerlark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in a scratch folder: what follows is planned from there, and not computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file with a header in the schema's order, cells trimmed, with or without a byte-order mark, which is in the
    header alone; the same character inside cells stays."""
    raw = spark.read.csv(path, header=True, schema=schema, encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE")
    return raw.select(*[F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Layout pages: a list of pages, each a list of [y, [[x, text], ...]]; page, line, y and frags (x, text).
    A file that is no such list fails the read."""
    strict = {"mode": "FAILFAST"}
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<array<string>>>", strict).alias("pages"))
    lines = whole.select(F.posexplode("pages").alias("page", "ls")).select("page", F.posexplode("ls").alias("line", "l"))
    frags = F.transform(F.from_json(F.get("l", F.lit(1)), "array<array<string>>", strict), lambda f: F.struct(F.get(f, F.lit(0)).cast("double").alias("x"), F.get(f, F.lit(1)).alias("text")))
    return lines.select("page", "line", F.get("l", F.lit(0)).cast("double").alias("y"), frags.alias("frags"))


def write_export(df: DataFrame, path: str) -> None:
    """UTF-8 with a header whose first name has the byte-order mark; nulls are empty cells."""
    marked = df.withColumnRenamed(df.columns[0], MARK + df.columns[0])
    marked.write.csv(path, header=True, nullValue="", emptyValue="", encoding="UTF-8")


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with a header and without a byte-order mark; nulls are empty cells."""
    df.write.csv(path, header=True, nullValue="", emptyValue="", encoding="UTF-8")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, ignoreNullFields=False)


def write_report(checks: DataFrame, path: str) -> None:
    """One line for each check."""
    checks.select(F.concat(F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit("  "), F.col("check"), F.lit(": got "), F.col("got").cast("string"), F.lit(", want "), F.col("want").cast("string")).alias("value")).write.text(path)


def write_sections(report: DataFrame, path: str) -> None:
    """A report (section, item, value) as text, a line for each item, by section and item."""
    line = F.concat(F.col("section"), F.lit("  "), F.col("item"), F.lit(": "), F.coalesce("value", F.lit("")))
    report.orderBy("section", "item").select(line.alias("value")).write.text(path)
