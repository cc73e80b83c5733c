"""A load in chunks that can be resumed: no chunk is lost, and none counts twice.

Rows are numbered by a hash of their key, which deals them into chunks. A run of chunks is a folder and, once it is whole, a
mark beside it; both have the number of its first chunk. A run is one chunk where a pass has few; where it has many, there
are some RUNS of them a pass, or more of about CHUNK rows, so that neither files nor calls grow with the number of chunks. A
load that starts again finds the marks and writes the runs without one anew. Rows are read from marked runs only, and only
when all are there.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError

CHUNK = 5_000_000
RUNS = 64


class Stage:
    """The staged rows of one load, under a folder of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def _plan(self) -> dict | None:
        if not self._fs.exists(self._path("plan.json")):
            return None
        stream = self._fs.open(self._path("plan.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> None:
        """A file that is whole if it is there."""
        out = self._fs.create(self._path(f".{name}"), True)
        try:
            out.write(json.dumps(value, sort_keys=True).encode())
        finally:
            out.close()
        self._fs.rename(self._path(f".{name}"), self._path(name))

    def done(self) -> list[int]:
        """The chunks that are whole."""
        if not self._fs.exists(self._path("")):
            return []
        plan = self._plan()
        return [c for first in self._marks() for c in range(first, min(first + plan["run"], plan["chunks"]))]

    def _marks(self) -> list[int]:
        """The first chunks of the runs that are whole."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[5:]) for n in names if n.startswith("done-"))

    def load(self, rows: DataFrame, keys: list[str], size: int = CHUNK, passes: int = 8) -> list[int]:
        """Writes the chunks that are not there yet, and gives their numbers. rows must be those of the first try, and keys
        tell them apart well enough to cut chunks of about size rows. The rows are read at most passes times, and what a
        pass has written stays if a later one fails."""
        plan = self._plan()
        if plan is None:
            n = rows.count()
            chunks = max(1, math.ceil(n / size))
            run = max(1, min(math.ceil(math.ceil(chunks / passes) / RUNS), CHUNK // size))
            plan = {"rows": n, "chunks": chunks, "run": run, "schema": rows.schema.json(), "keys": keys}
            self._put("plan.json", plan)
        elif plan["schema"] != rows.schema.json() or plan["keys"] != keys:
            raise EngineError("OTHER_LOAD", "the stage has rows of another kind", "rows")
        run, done = plan["run"], self._marks()
        chunk = F.pmod(F.xxhash64(*keys), F.lit(plan["chunks"]))
        missing = sorted(set(range(0, plan["chunks"], run)) - set(done))
        together = max(1, math.ceil(len(missing) / passes))
        for at in range(0, len(missing), together):
            some = missing[at : at + together]
            for name in ["parts", *[f"chunk={c}" for c in some]]:
                self._fs.delete(self._path(name), True)  # of a try that did not end
            part = rows.withColumn("_chunk", chunk - chunk % run).where(F.col("_chunk").between(some[0], some[-1]) & ~F.col("_chunk").isin([c for c in done if some[0] < c < some[-1]]))
            part.repartition("_chunk").write.partitionBy("_chunk").parquet(f"{self.root}/parts")
            for c in some:
                if self._fs.exists(source := self._path(f"parts/_chunk={c}")):
                    self._fs.rename(source, self._path(f"chunk={c}"))
                self._put(f"done-{c}", {"chunk": c})
            self._fs.delete(self._path("parts"), True)
        return [c for first in missing for c in range(first, min(first + run, plan["chunks"]))]

    def rows(self) -> DataFrame:
        """All rows; fails while a chunk is missing, or if there are more or fewer rows than were announced."""
        plan = self._plan()
        if plan is None or len(self.done()) < plan["chunks"]:
            raise EngineError("NOT_STAGED", "chunks are missing", "root")
        schema = self.spark.createDataFrame([], _schema(plan["schema"])).schema
        folders = [f"{self.root}/chunk={c}" for c in self._marks() if self._fs.exists(self._path(f"chunk={c}"))]
        found = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        if (n := found.count()) != plan["rows"]:
            raise EngineError("OTHER_LOAD", f"{n} rows are staged, {plan['rows']} were announced", "rows")
        return found

    def drop(self) -> None:
        self._fs.delete(self._path(""), True)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))
