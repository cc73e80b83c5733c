"""Jobs as a log of events: their latest state in batch and as a stream, and the work on claimed jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.streaming.client import Client

POLL = "3 seconds"
STATUSES = ("pending", "processing", "completed", "failed")


def latest(events: DataFrame, job: str, at: str, tie: str, status: str) -> DataFrame:
    """The last status of each job, by time and then tie, with how many events it has. Nulls of at come first."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(at, tie)).alias(status), F.max(at).alias(at), F.count(F.lit(1)).alias("n_events"))


def claim(jobs: DataFrame, at: str = "created_at", key: str = "id", status: str = "status") -> DataFrame:
    """The pending job that has waited longest; of several, the one with the least id."""
    return jobs.where(F.col(status) == "pending").orderBy(F.col(at).asc_nulls_last(), key).limit(1)


def view(status: Column, result: Column, error: Column) -> Column:
    """What a client is told: the status, and with it the error or the result."""
    return F.struct(status.alias("status"), F.when(status == "failed", error).alias("error"), F.when(status == "completed", result).alias("data"))


def process(jobs: DataFrame, work: Callable[[str], str], path: str = "image_path", seconds: float | None = None, pool: int = 4, attempts: int = 1) -> DataFrame:
    """jobs with status, result and error_message after work(path): completed, or failed with the error's text. Work that
    takes more than so many seconds is ended and has failed; work on a null path has failed."""
    client = Client(work, pool=pool, seconds=seconds, attempts=attempts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = client.outcomes(batch[path].tolist())
            yield batch.assign(status=["completed" if o.error is None else "failed" for o in out], result=[o.result for o in out], error_message=[o.error for o in out])

    return jobs.mapInPandas(run, jobs.schema)


def latest_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, sink: str, job: str, at: str, tie: str, status: str) -> DataFrame:
    """latest() over a folder read as a stream until it has all that is there; the state after the last batch.

    Times without a zone are read as UTC. Each batch adds only the jobs that it changed to the sink's table, where a job's
    last batch is its state; with the checkpoint beside it, a restarted query goes on where it was.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    state = latest(stream.withColumn(at, F.col(at).cast("timestamp")), job, at, tie, status)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/state/batch={number}")

    query = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{sink}/state")
    return changes.groupBy(job).agg(F.max_by(F.struct(status, at, "n_events"), "batch").alias("s")).select(job, "s.*")


def polling(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands new jobs to handle every POLL; one query owns the stream, so no job is claimed twice."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=POLL).start()
