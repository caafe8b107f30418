"""Snapshot files as a data source, in batch and as a stream: ``spark.read.format("snapshots").load(path)``.

The path holds snapshot files, or folders ``version=N`` of them; each file is a partition.
Rows are those of ``snapshots.read_files``, with the file's version, and a stream's offsets
are versions: a batch has all files of the versions that are new. Equality and set filters
on db_file and version choose files before any is opened, and those on store and category
choose them by their header. The option ``columns`` (comma-separated) names the columns wanted.

Files are reached through pyarrow's file systems, which take a path's URI.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

HEADER = {"store": "store", "store_label": "storeLabel", "category": "category", "category_label": "categoryLabel", "source": "source", "updated_at": "updatedAt"}
TEXTS = {"name": ["name"], "price": ["price"], "sku": ["sku"], "url": ["url"], "img": ["img", "image", "thumb"]}
COLUMNS = T.StructType([T.StructField(c, T.LongType() if c in ("version", "ord") else T.BooleanType() if c == "removed" else T.StringType()) for c in ("db_file", "version", *HEADER, "ord", *TEXTS, "removed")])


@dataclass
class SnapshotFile(InputPartition):
    path: str
    version: int
    headers: dict = field(default_factory=dict)


def _text(value) -> str:
    """A JSON value as text: a text itself, a number or flag as it is written, nothing for null."""
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def rows_of(body: dict, path: str, version: int) -> list[dict]:
    """The listings of a decoded file: those with an http URL, the last one of each URL."""
    head = {c: None if body.get(k) is None else _text(body[k]) for c, k in HEADER.items()}
    last = {}
    items = body.get("items")
    for at, item in enumerate(items if isinstance(items, list) else []):
        if not isinstance(item, dict):
            continue
        texts = {c: next((t for t in (_text(item.get(k)) for k in keys) if t), "") for c, keys in TEXTS.items()}
        if texts["url"].startswith("http"):
            removed = "" if item.get("removed") is None else _text(item["removed"]).lower()
            last[texts["url"]] = {"db_file": path, "version": version, **head, "ord": at, **texts, "removed": removed not in ("false", "0", "", "null")}
    return list(last.values())


class SnapshotFiles:
    """The files under a path and their rows."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.names = path, schema.names

    def found(self) -> list[SnapshotFile]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True))
        named = [i.path for i in infos if i.type == fs.FileType.File and i.path.endswith(".json")]
        version = lambda p: int(m[1]) if (m := re.search(r"/version=(\d+)/", p)) else 0
        return sorted((SnapshotFile(p, version(p)) for p in named), key=lambda f: (f.version, f.path))

    def rows(self, part: SnapshotFile) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        try:
            with store.open_input_stream(part.path) as stream:
                body = json.loads(stream.readall())
        except ValueError:  # a corrupt file has no rows, as for the other reader
            return
        if not isinstance(body, dict) or any(body.get(HEADER[c]) not in allowed for c, allowed in part.headers.items()):
            return
        rows = rows_of(body, part.path, part.version)
        kinds = {"version": pa.int64(), "ord": pa.int64(), "removed": pa.bool_()}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], names=self.names)


class SnapshotReader(DataSourceReader):
    def __init__(self, files: SnapshotFiles):
        self.files, self.allowed = files, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and set filters on the columns that choose files; the others stay with the engine."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("db_file", "version", "store", "category"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[SnapshotFile]:
        keep = lambda f: all(v in self.allowed[c] for c, v in (("db_file", f.path), ("version", f.version)) if c in self.allowed)
        headers = {c: self.allowed[c] for c in ("store", "category") if c in self.allowed}
        return [SnapshotFile(f.path, f.version, headers) for f in self.files.found() if keep(f)]

    def read(self, partition: SnapshotFile) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)


class SnapshotStreamReader(DataSourceStreamReader):
    def __init__(self, files: SnapshotFiles, since: int):
        self.files, self.since = files, since

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        return {"version": max((f.version for f in self.files.found()), default=self.since)}

    def partitions(self, start: dict, end: dict) -> list[SnapshotFile]:
        return [f for f in self.files.found() if start["version"] < f.version <= end["version"]]

    def read(self, partition: SnapshotFile) -> Iterator[pa.RecordBatch]:
        return self.files.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: versions stay."""


class SnapshotSource(DataSource):
    """Options: path, columns (those wanted, in order; all by default), since (a stream begins behind this version; 0)."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> T.StructType:
        wanted = self.options.get("columns")
        return T.StructType([COLUMNS[c.strip()] for c in wanted.split(",")]) if wanted else COLUMNS

    def reader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(SnapshotFiles(self.options["path"], schema))

    def streamReader(self, schema: T.StructType) -> SnapshotStreamReader:
        return SnapshotStreamReader(SnapshotFiles(self.options["path"], schema), int(self.options.get("since", "0")))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
