"""Several tables published together: versions, a manifest for each, rollback.

A version is a manifest, one small file that names the folder of each table. Tables are written to folders of their own
first and never changed, so a version is there as a whole from the moment its manifest is, and not at all before. The
manifest's name is its number, and it is created only if it is not there: of two publishers of one number one fails. What
a failed publisher has written is named by no manifest; sweep() removes it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.errors import EngineError
from ledgerlark.operators import gates

Checks = Callable[[dict[str, DataFrame]], list[DataFrame]]


class Store:
    """The versions under one folder, which all machines see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """The numbers of all versions, oldest first."""
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int:
        """The number of the newest version; 0: there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        """{version, parent, note, tables: {name: {folder, rows}}} of a version."""
        path = self._path(f"manifests/{version:09d}.json")
        if not self._fs.exists(path):
            raise EngineError("NO_VERSION", f"there is no version {version}", "version")
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest unless given."""
        tables = self.manifest(version or self.latest())["tables"]
        if name not in tables:
            raise EngineError("NO_TABLE", f"the version has no table {name}", "name")
        return self.spark.read.parquet(f"{self.root}/{tables[name]['folder']}")

    def publish(self, tables: dict[str, DataFrame], checks: Checks | None = None, note: str = "", apply: bool = True, parent: int | None = None) -> int:
        """The number of a new version with these tables, and with the others of the parent (the newest version unless
        given; publishing fails if another version came after it). Checks see all tables of the new version as they are
        written; if one fails, or with apply=False (a dry run: the number is what it would have been), there is no version."""
        parent = self.latest() if parent is None else parent
        known = self.manifest(parent)["tables"] if parent else {}
        written: dict[str, dict] = {}
        try:
            for name, rows in tables.items():
                folder = f"data/{name}-{uuid.uuid4().hex}"
                written[name] = {"folder": folder}  # known before it is written, so that what a failure leaves is removed
                rows.write.parquet(f"{self.root}/{folder}")
                written[name]["rows"] = self.spark.read.parquet(f"{self.root}/{folder}").count()
            now = known | written
            if checks:
                gates.enforce(checks({name: self.spark.read.parquet(f"{self.root}/{t['folder']}") for name, t in now.items()}))
            if apply:
                self._commit({"version": parent + 1, "parent": parent, "note": note, "tables": now})
        except BaseException:
            self._remove(written)
            raise
        if not apply:
            self._remove(written)
        return parent + 1

    def _commit(self, manifest: dict) -> None:
        path = self._path(f"manifests/{manifest['version']:09d}.json")
        if self._fs.exists(path):
            raise EngineError("LOST_RACE", f"version {manifest['version']} is there already", "parent")
        # Renaming to a name that is there fails, so a manifest is seen whole or not at all, and only one wins.
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        self._fs.mkdirs(path.getParent())
        out = self._fs.create(aside, False)
        try:
            out.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(aside), self._fs.makeQualified(path), options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise EngineError("LOST_RACE", f"version {manifest['version']} is there already", "parent") from e

    def _remove(self, written: dict[str, dict]) -> None:
        for t in written.values():
            self._fs.delete(self._path(t["folder"]), True)

    def rollback(self, to: int, note: str = "") -> int:
        """A new version with the tables of a former one; nothing is written but its manifest."""
        tables, parent = self.manifest(to)["tables"], self.latest()
        self._commit({"version": parent + 1, "parent": parent, "note": note or f"back to version {to}", "tables": tables})
        return parent + 1

    def rollback_range(self, name: str, to: int, keys: list[str], where: Column, expect: int | None, checks: Checks | None = None) -> int:
        """A new version in which the rows of a table that meet the condition are as they were in a former version: rows
        that came since are gone, changed ones have their old values, deleted ones are back. expect guards it: so many
        rows meet the condition now, or nothing is done (None: not guarded)."""
        now, then = self.read(name), self.read(name, to)
        if expect is not None and (n := now.where(where).count()) != expect:
            raise EngineError("ROLLBACK_GUARD", f"{n} rows of {name} meet the condition, not {expect}", "expect")
        for side in (now, then):
            if side.where(where).select(*keys).groupBy(*keys).count().where("count > 1").head(1):
                raise EngineError("ROLLBACK_KEYS", f"{', '.join(keys)} is not unique in {name}", "keys")
        columns = now.columns
        filled = then.select(*[F.col(c) if c in then.columns else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in columns])
        rest = now.where(~F.coalesce(where, F.lit(False)))
        return self.publish({name: rest.unionByName(filled.where(where))}, checks, f"{name}: rows back to version {to}")

    def changes(self, name: str, old: int, new: int, keys: list[str]) -> DataFrame:
        """keys and change (inserted, deleted, updated) of the rows in which two versions differ; one shuffle by the keys."""
        before, after = self.read(name, old), self.read(name, new)
        rest = [c for c in after.columns if c not in keys]
        digest = lambda df: F.xxhash64(*[F.col(c) if c in df.columns else F.lit(None).cast(after.schema[c].dataType) for c in rest])
        sides = before.select(*keys, digest(before).alias("o"), F.lit(None).cast("long").alias("n")).unionByName(after.select(*keys, F.lit(None).cast("long").alias("o"), digest(after).alias("n")))
        both = sides.groupBy(*keys).agg(F.max("o").alias("o"), F.max("n").alias("n"))
        change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "updated")
        return both.select(*keys, change.alias("change")).where("change is not null")

    def sweep(self) -> list[str]:
        """Removes table folders that no version names, and gives their names; no publisher may be at work."""
        named = {t["folder"] for v in self.versions() for t in self.manifest(v)["tables"].values()}
        folder = self._path("data")
        if not self._fs.exists(folder):
            return []
        gone = [n for s in self._fs.listStatus(folder) if (n := f"data/{s.getPath().getName()}") not in named]
        for n in gone:
            self._fs.delete(self._path(n), True)
        return sorted(gone)
