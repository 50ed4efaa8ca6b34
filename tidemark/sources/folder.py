"""A folder of files as a table of what it holds, and as a stream of what changes in it.

``spark.read.format("folder").load(path)`` lists files without opening them: (path, size_bytes, mtime).
``spark.readStream.format("folder").option("state", shared).load(path)`` gives (ts, event_id, kind, path, size_bytes,
mtime): each batch compares a listing with the one before. ``register`` makes the format known to a session.

Work is parted by subfolders of the root (``levels`` deep), each listed by a task of its own. A task
writes its listing under the batch's number before it tells the changes, and a task that is run again reads
that listing instead of making another, so a batch tells the same changes each time. Paths are of the local
machine, which on a cluster must be a mount that all executors share, or of a store that pyarrow knows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FILES = "path string, size_bytes bigint, mtime double"
EVENTS = f"ts timestamp, event_id bigint, kind string, {FILES}"
_SNAPSHOT = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime", pa.float64())])


@dataclass
class Part(InputPartition):
    """A subfolder; ``deep``: with all below it."""

    folder: str
    deep: bool
    start: int = 0
    end: int = 0


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _list(store: fs.FileSystem, folder: str, deep: bool) -> list[tuple[str, int, float]]:
    """Files of a folder, sorted; none if it isn't there."""
    found = store.get_file_info(fs.FileSelector(folder, recursive=deep, allow_not_found=True))
    return sorted((i.path, i.size or 0, i.mtime_ns / 1e9 if i.mtime_ns is not None else 0.0) for i in found if i.type == fs.FileType.File)


def _parts(store: fs.FileSystem, root: str, levels: int, recursive: bool) -> list[Part]:
    """The root's subfolders ``levels`` deep, with all below; those above them without."""
    found, now = [Part(root, False)], [root]
    for level in range(levels if recursive else 0):
        now = [i.path for f in now for i in store.get_file_info(fs.FileSelector(f, allow_not_found=True)) if i.type == fs.FileType.Directory]
        found += [Part(f, level == levels - 1) for f in sorted(now)]
    return found


class Listing(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.levels, self.recursive = options["path"], int(options.get("levels", 1)), options.get("recursive", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        store, root = _at(self.root)
        return _parts(store, root, self.levels, self.recursive)

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from _list(_at(self.root)[0], partition.folder, partition.deep)


class Changes(DataSourceStreamReader):
    """Offsets are numbers of listings, which lie in ``state``; the first batch tells all files as changed."""

    def __init__(self, options: dict):
        self.listing = Listing(options)
        if "state" not in options:
            raise ValueError("option state must name a folder that all executors share")
        self.store, self.state = _at(options["state"])
        self.last = max(self._numbers(), default=0)

    def _numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.state, allow_not_found=True))
        return [int(i.base_name) for i in found if i.type == fs.FileType.Directory and i.base_name.isdigit()]

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.last += 1
        return {"n": self.last}

    def _snapshot(self, n: int, folder: str) -> str:
        return f"{self.state}/{n}/{quote(folder, safe='')}"

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["n"])
        store, root = _at(self.listing.root)
        parts = {p.folder: p.deep for p in _parts(store, root, self.listing.levels, self.listing.recursive)}
        for n in (start["n"], end["n"]):  # folders that are gone by now have changes to tell as well
            for i in self.store.get_file_info(fs.FileSelector(f"{self.state}/{n}", allow_not_found=True)):
                if not i.base_name.endswith(".tmp"):
                    parts.setdefault(unquote(i.base_name), True)
        return [Part(f, deep, start["n"], end["n"]) for f, deep in sorted(parts.items())]

    def _held(self, n: int, folder: str) -> tuple[dict, float] | None:
        at = self._snapshot(n, folder)
        if self.store.get_file_info(at).type == fs.FileType.NotFound:
            return None
        table = pq.read_table(at, filesystem=self.store)
        rows = zip(*(table.column(k).to_pylist() for k in _SNAPSHOT.names), strict=True)
        return {r[0]: r[1:] for r in rows}, float(table.schema.metadata[b"at"])

    def read(self, partition: Part) -> Iterator[tuple]:
        now = self._held(partition.end, partition.folder)
        if now is None:
            rows = _list(_at(self.listing.root)[0], partition.folder, partition.deep)
            table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, _SNAPSHOT.types, strict=True)], schema=_SNAPSHOT.with_metadata({"at": repr(time.time())}))
            at = self._snapshot(partition.end, partition.folder)
            self.store.create_dir(at.rpartition("/")[0], recursive=True)
            fresh = f"{at}.{uuid.uuid4().hex}.tmp"
            pq.write_table(table, fresh, filesystem=self.store)
            self.store.move(fresh, at)
            now = self._held(partition.end, partition.folder)
        before = self._held(partition.start, partition.folder) if partition.start else None
        (files, at), (old, _) = now, before or ({}, 0.0)
        ts = datetime.fromtimestamp(at, UTC)
        for path in sorted(files.keys() | old.keys()):
            if files.get(path) != old.get(path):
                size, mtime = files.get(path) or old[path]
                yield (ts, partition.end, "changed" if path in files else "deleted", path, size, mtime)

    def commit(self, end: dict) -> None:
        for n in self._numbers():
            if n < end["n"]:
                self.store.delete_dir(f"{self.state}/{n}")

    def stop(self) -> None:
        pass


class FolderSource(DataSource):
    """Options: ``path``; ``recursive`` (true); ``levels`` (1), how deep subfolders are parted; ``state`` for streams."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return EVENTS if "state" in self.options else FILES

    def reader(self, schema) -> DataSourceReader:
        return Listing(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Changes(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)


def moves(events: DataFrame) -> DataFrame:
    """A batch of the stream as (ts, event_id, kind, path, dest): a deletion and a new file of the same size and
    time are one move, if no other of the batch has these; ``streaming.watch.moved`` tells it as both again."""
    same = ["size_bytes", "mtime"]
    one = lambda kind, name: events.where(F.col("kind") == kind).groupBy(*same).agg(F.count("*").alias(f"{name}_n"), F.min("path").alias(name))
    pairs = one("deleted", "source").join(one("changed", "dest"), same).where("source_n = 1 and dest_n = 1").select("source", "dest")
    told = events.join(pairs, events.path == pairs.source, "left").drop("source").join(pairs.select(F.col("dest").alias("taken")), F.col("path") == F.col("taken"), "left_anti")
    kind = F.when(F.col("dest").isNotNull() & (F.col("kind") == "deleted"), "moved").otherwise(F.col("kind"))
    return told.select("ts", "event_id", kind.alias("kind"), "path", F.when(kind == "moved", F.col("dest")).alias("dest"))
