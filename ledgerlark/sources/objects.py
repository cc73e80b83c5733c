"""Objects of a store as a Spark data source: one row for each object, or one for each text fragment of laid-out pages.

    spark.read.format("objects").load(root)                  path, size, modified, content
    spark.read.format("objects").schema("path string, size long").load(root)
    spark.read.format("fragments").load(root)                path, page, place, x, y, text
    df.write.format("objects").save(root)                    from path (below the root) and content

Objects are dealt into partitions by their sizes. Only the columns of the schema are made: without content no object is
opened. Conditions on path reach the listing (with spark.sql.python.filterPushdown.enabled). Roots are URIs that
pyarrow can open, or local paths. Options: glob, partition_bytes, and overwrite for writing.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerlark.errors import EngineError

PARTITION_BYTES = 64 << 20


def _open(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return system, path.rstrip("/")


@dataclass
class _Group(InputPartition):
    """Objects that one task reads: (path below the root, size, modified)."""

    objects: list


@dataclass
class _Written(WriterCommitMessage):
    objects: list


class _Reader(DataSourceReader):
    def __init__(self, root: str, options: dict, columns: list[str]):
        self.root, self.columns = root, columns
        self.glob, self.most = options.get("glob", "*"), int(options.get("partition_bytes", PARTITION_BYTES))
        self.only: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, EqualTo | In | StringStartsWith):
                self.only.append(("starts", (f.value,)) if isinstance(f, StringStartsWith) else ("in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        return fnmatch.fnmatch(path.rsplit("/", 1)[-1], self.glob) and all(path.startswith(v) if kind == "starts" else path in v for kind, v in self.only)

    def partitions(self) -> list[_Group]:
        from pyarrow import fs

        system, top = _open(self.root)
        info = system.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise EngineError("NO_ROOT", f"{self.root} is not there", "root")
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(top, recursive=True))
        own = sorted((i.path[len(top) + 1 :] or i.base_name, i.size, i.mtime) for i in found if i.is_file)
        groups, size = [[]], 0
        for path, n, modified in own:
            if not self._wanted(path):
                continue
            if groups[-1] and size + n > self.most:
                groups.append([])
                size = 0
            groups[-1].append((path, n, modified))
            size += n
        return [_Group(g) for g in groups if g]

    def _content(self, system, top: str, path: str) -> bytes:
        from pyarrow import fs

        whole = top if system.get_file_info(top).type == fs.FileType.File else f"{top}/{path}"
        with system.open_input_stream(whole) as stream:
            return stream.read()


class _ObjectReader(_Reader):
    def read(self, partition: _Group) -> Iterator[tuple]:
        system, top = _open(self.root)
        for path, size, modified in partition.objects:
            give = {"path": path, "size": size, "modified": modified, "content": self._content(system, top, path) if "content" in self.columns else None}
            yield tuple(give[c] for c in self.columns)


class _FragmentReader(_Reader):
    def read(self, partition: _Group) -> Iterator[tuple]:
        from ledgerlark.sources import pdf

        system, top = _open(self.root)
        for path, _, _ in partition.objects:
            for page, place, x, y, text in pdf.read(self._content(system, top, path)):
                give = {"path": path, "page": page, "place": place, "x": x, "y": y, "text": text}
                yield tuple(give[c] for c in self.columns)


class _Writer(DataSourceWriter):
    """Each object is written aside and moved to its place, and then looked up: a task fails whose object is not there."""

    def __init__(self, root: str, columns: list[str], overwrite: bool):
        if not {"path", "content"} <= set(columns):
            raise EngineError("NO_CONTENT", "objects are written from path and content", "df")
        self.root, self.overwrite = root, overwrite

    def write(self, iterator) -> _Written:
        from pyarrow import fs

        system, top = _open(self.root)
        done = []
        for row in iterator:
            name = f"{top}/{row['path']}"
            there = system.get_file_info(name).type != fs.FileType.NotFound
            if there and not self.overwrite:
                raise EngineError("OBJECT_EXISTS", f"{row['path']} is there already", "path")
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            aside = f"{name}.{uuid.uuid4().hex}"
            content = bytes(row["content"] or b"")
            with system.open_output_stream(aside) as out:
                out.write(content)
            system.move(aside, name)
            stored = system.get_file_info(name)
            if stored.type != fs.FileType.File or stored.size != len(content):
                raise EngineError("NOT_STORED", f"{row['path']} was not stored", "path")
            done.append((row["path"], there))
        return _Written(done)

    def commit(self, messages: list) -> None:
        paths = [p for m in messages if m for p, _ in m.objects]
        if len(set(paths)) < len(paths):
            raise EngineError("OBJECT_EXISTS", "two rows have one path", "path")

    def abort(self, messages: list) -> None:
        """What tasks have stored anew goes again; objects that were there before stay as they are now."""
        system, top = _open(self.root)
        for m in messages:
            for path, there in m.objects if m else []:
                if not there:
                    system.delete_file(f"{top}/{path}")


class Objects(DataSource):
    SCHEMA = "path string, size long, modified timestamp, content binary"
    READER: type[_Reader] = _ObjectReader

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return self.SCHEMA

    def _root(self) -> str:
        if not self.options.get("path"):
            raise EngineError("NO_ROOT", "load() and save() need a root", "path")
        return self.options["path"]

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.READER(self._root(), self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._root(), schema.names, overwrite)


class Fragments(Objects):
    SCHEMA = "path string, page long, place long, x double, y double, text string"
    READER = _FragmentReader

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        raise EngineError("READ_ONLY", "fragments are read only", "format")


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Objects, Fragments):
        spark.dataSource.register(source)


def fragments(spark: SparkSession, root: str, **options) -> DataFrame:
    """The text fragments of all objects below a root."""
    register(spark)
    return spark.read.format("fragments").options(**options).load(root)
