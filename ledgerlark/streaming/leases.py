"""Claims of jobs on a stream: one owner at a time, by leases that expire.

State is kept for each job (transformWithState). A worker claims a job that is pending, or whose lease has run out; it
keeps it by beats, and ends it within its lease. A timer gives a job back when the watermark passes the end of its lease,
so that jobs of workers that are gone are seen to be free without another claim.

Requests are decided in the order in which batches bring them, within a batch by time and then tie. A job's clock does not
go back: a late request counts as of the time of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a request is to be: a step of a job, by a worker.
ACTIONS = ("submit", "claim", "beat", "done", "fail")


@dataclass(frozen=True)
class Job:
    """status none, pending, processing, completed or failed; owner and until (the lease's last moment) while processing;
    at: the time of the last request; steps: how many requests there were; claims: how often it was claimed."""

    status: str = "none"
    owner: str | None = None
    until: datetime | int | None = None
    at: datetime | int | None = None
    steps: int = 0
    claims: int = 0


def decide(job: Job, action: str | None, worker: str | None, at: datetime | int, lease: timedelta | int) -> tuple[Job, bool]:
    """The job after a request, and whether the request was granted; moments and lease are datetimes, or all microseconds."""
    at = max(at, job.at) if job.at is not None else at
    job = replace(job, at=at, steps=job.steps + 1)
    held = job.status == "processing" and at <= job.until
    mine = held and worker is not None and worker == job.owner
    if action == "submit" and job.status in ("none", "completed", "failed"):
        return replace(job, status="pending", owner=None, until=None), True
    if action == "claim" and worker is not None and (job.status == "pending" or (job.status == "processing" and not held)):
        return replace(job, status="processing", owner=worker, until=at + lease, claims=job.claims + 1), True
    if action == "beat" and mine:
        return replace(job, until=at + lease), True
    if action in ("done", "fail") and mine:
        return replace(job, status="completed" if action == "done" else "failed", owner=None, until=None), True
    return job, False


#: One row for each request and for each lease that a timer ended (action expire).
STEPS = "{job} {type}, step long, at timestamp, action string, worker string, granted boolean, status string, owner string, until timestamp, claims long"
#: Within the processor moments are microseconds, so that no row passes through objects of a library.
_STATE = "status string, owner string, until long, at long, steps long, claims long"
_FIELDS = ("step", "at", "action", "worker", "granted", "status", "owner", "until", "claims")
_OUT = "{job} {type}, step array<long>, at array<long>, action array<string>, worker array<string>, granted array<boolean>, status array<string>, owner array<string>, until array<long>, claims array<long>"
#: So many steps of a job leave the processor as one row of arrays.
TOGETHER = 1024


class Leases(StatefulProcessor):
    """Decides the requests (us, tie, action, worker) of each job."""

    def __init__(self, job: str, lease: timedelta):
        self.job, self.lease = job, lease // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def _keep(self, job: Job) -> None:
        self.state.update((job.status, job.owner, job.until, job.at, job.steps, job.claims))

    def _row(self, key, steps: list[tuple]) -> Row:
        return Row(**{self.job: key[0]}, **dict(zip(_FIELDS, map(list, zip(*steps, strict=True)), strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        before = job = Job(*held) if held is not None else Job()
        steps = []
        for _, _, _, action, worker, us in sorted(rows, key=lambda r: (r[5], r[2] is None, r[2])):  # job, at, tie, action, worker, us
            job, granted = decide(job, action, worker, us, self.lease)
            steps.append((job.steps, job.at, action, worker, granted, job.status, job.owner, job.until, job.claims))
            if len(steps) == TOGETHER:
                yield self._row(key, steps)
                steps = []
        if steps:
            yield self._row(key, steps)
        self._keep(job)
        if job.until != before.until:
            if before.until is not None:
                self.handle.deleteTimer(_millis(before.until))
            if job.until is not None:
                self.handle.registerTimer(_millis(job.until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = Job(*self.state.get())
        if job.status == "processing" and _millis(job.until) <= expiredTimerInfo.getExpiryTimeInMs():
            job = replace(job, status="pending", owner=None, until=None)
            self._keep(job)
            yield self._row(key, [(job.steps, job.at, "expire", None, True, job.status, job.owner, job.until, job.claims)])

    def close(self) -> None:
        pass


def _millis(us: int) -> int:
    """The first millisecond after a lease's last moment."""
    return us // 1000 + 1


def decided(requests: DataFrame, job: str, lease: timedelta, delay: str = "1 hour") -> DataFrame:
    """A stream of steps of a stream of requests (job, at, tie, action, worker); rows without job or time are left out.
    delay: how late a request may come before the leases that end by then are given back."""
    kind = dict(requests.dtypes)[job]
    used = requests.where(F.col(job).isNotNull() & F.col("at").isNotNull()).select(job, F.col("at").cast("timestamp").alias("at"), "tie", "action", "worker")
    keyed = used.withWatermark("at", delay).withColumn("us", F.unix_micros("at")).groupBy(job)
    out = keyed.transformWithState(Leases(job, lease), _OUT.format(job=job, type=kind), "Append", "EventTime")
    one = out.select(job, F.inline(F.arrays_zip(*_FIELDS)))
    return one.withColumns({c: F.timestamp_micros(c) for c in ("at", "until")})


def run(spark: SparkSession, requests: DataFrame, job: str, lease: timedelta, sink: str, delay: str = "1 hour") -> DataFrame:
    """All steps of what a stream has by now, those of earlier runs with the same sink included: a run goes on where the
    last one stopped, and a batch that is done again after a failure replaces its own rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    steps = decided(requests, job, lease, delay)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/steps/batch={number}")

    steps.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{sink}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stored(spark, sink, steps.schema)


def stored(spark: SparkSession, sink: str, schema: StructType) -> DataFrame:
    """The steps that a sink has."""
    return spark.read.schema(schema).parquet(f"{sink}/steps")


def owners(steps: DataFrame, job: str, now) -> DataFrame:
    """status, owner and claims of each job at a time after its last step; a lease that has run out has no owner."""
    last = steps.groupBy(job).agg(F.max_by(F.struct("status", "owner", "until", "claims"), F.struct("step", F.col("action") == "expire")).alias("s"))
    out = (F.col("s.status") == "processing") & (F.col("s.until") < now)
    return last.select(job, F.when(out, F.lit("pending")).otherwise(F.col("s.status")).alias("status"), F.when(~out, F.col("s.owner")).alias("owner"), F.col("s.claims").alias("claims"))
