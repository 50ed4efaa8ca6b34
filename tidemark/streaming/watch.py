"""The change stream: events debounced per micro-batch and merged into kept tables.

A batch writes the rows of the files it touches, under a key of its own (the query and the batch), so its cost is that of
its events, a batch that is run again leaves the same tables, and one of a new query or after a repair isn't taken for an old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import Kept, Postings, text_chunks

FILES = "file_id long, path string, mtime double, size_bytes long, version long"
CHUNKS = "file_id long, ordinal int, text string"
VECTORS = "file_id long, ordinal int, space string, vec array<double>"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; a move is a deletion and a change before it gets here."""
    return events.groupBy("path").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.max("event_id").alias("version"))


def moved(events: DataFrame) -> DataFrame:
    """Rows (ts, event_id, kind, path, dest) with each move as a deletion and a change."""
    both = F.when(F.col("kind") == "moved", F.array(F.struct(F.lit("deleted").alias("kind"), "path"), F.struct(F.lit("changed").alias("kind"), F.col("dest").alias("path")))).otherwise(F.array(F.struct("kind", "path")))
    return events.select("ts", "event_id", F.inline(both))


class Index:
    """Files, chunks, vectors and postings below ``folder``. A file's id is a hash of its path."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files, self.chunks = Kept(spark, f"{folder}/files", FILES), Kept(spark, f"{folder}/chunks", CHUNKS)
        self.vectors, self.postings = Kept(spark, f"{folder}/vectors", VECTORS), Postings(spark, f"{folder}/postings")

    def apply(self, events: DataFrame, contents: DataFrame, key: str | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Merges a batch's final event of each path. ``contents`` (path, mtime, size_bytes, text):
        what the files hold now; a changed path without contents is gone, one whose time and size are
        known already is left alone. ``vectors`` makes vectors of chunks."""
        last = latest(events).withColumn("file_id", F.xxhash64("path"))
        now = last.where("kind = 'changed'").join(contents, "path")
        known = self.files.read().select("file_id", F.col("mtime").alias("old_mtime"), F.col("size_bytes").alias("old_size"))
        fresh = now.join(known, "file_id", "left").where("not (mtime <=> old_mtime and size_bytes <=> old_size)")
        gone = last.join(now.select("path"), "path", "left_anti").select("file_id")
        # the vectors of a file go with it also if it changed and has fewer chunks now
        made = text_chunks(fresh.select("file_id", "text"))
        touched = gone.unionByName(fresh.select("file_id"))
        own = self.chunks.rows_of(self.chunks.update(made, touched, key), fresh.select("file_id"))
        self.vectors.update(vectors(own) if vectors else self.vectors.spark.createDataFrame([], VECTORS), touched, key)
        self.postings.update(own, touched, key)
        self.files.update(fresh.select(*[f.split()[0] for f in FILES.split(", ")]), gone, key)

    def compact(self) -> None:
        for table in (self.files, self.chunks, self.vectors, self.postings):
            table.compact()


def watch(spark: SparkSession, events: DataFrame, index: Index, contents: Callable[[DataFrame], DataFrame], checkpoint: str, paused=lambda: False, every: str | None = None, vectors: Callable[[DataFrame], DataFrame] | None = None, compact_every: int = 200) -> StreamingQuery:
    """Merge a stream of (ts, event_id, kind, path) into ``index``. ``contents`` gives what the files
    of (path) hold. While ``paused`` says so, a batch's events are dropped. Without ``every`` it ends
    when all is read. Every ``compact_every`` batches the kept tables are compacted."""

    def merge(batch: DataFrame, number: int) -> None:
        if not paused():
            query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")  # a new checkpoint is a new query
            index.apply(batch, contents(batch.select("path").distinct()), f"{query}/{number}", vectors)
        if number % compact_every == compact_every - 1:
            index.compact()

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tumbling(events: DataFrame, size: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Counts by kind in windows of event time, with late events up to ``late``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("n"))


def running(events: DataFrame) -> DataFrame:
    """Counts by kind over all events so far; on a stream in complete or update mode."""
    return events.groupBy("kind").agg(F.count("*").alias("n"))
