"""Kept tables that change by key: files, chunks, vectors and postings.

A table is a folder of segments, one for each update, and a log of which files each update
touched. An update writes the rows of its files and their ids, never anything else, so its cost is
that of its own rows. A row counts if no later update touched its file.

Each update claims a number that no other has, writes, and counts from the moment that its
commit, one empty file, is there. Its name holds the number and a hash of the update's key, so an update that
is run again, under the same key, does nothing, whoever else has updated the table between. Compaction is such an
update as well: its commit takes the place of all up to a number at once, and only then their files go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import search as S


class Kept:
    """Rows with a ``file_id`` below ``folder``; ``by`` names a column to part segments by."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, by: str | None = None):
        self.spark, self.folder, self.schema, self.by = spark, folder.rstrip("/"), schema, by
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.folder}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _commits(self) -> tuple[dict[str, int], dict[int, int]]:
        """Numbers by the hash of their key, and those that count: each with the number it stands for."""
        found = [name.split(".") for name in self._names("commits")]
        base = max((int(upto), int(n)) for n, _, upto in found if upto) if any(upto for _, _, upto in found) else (-1, -1)
        live = {int(n): int(n) for n, _, upto in found if not upto and int(n) > base[0]}
        return {key: int(n) for n, key, upto in found if not upto}, ({base[1]: base[0]} if base[1] >= 0 else {}) | live

    def updates(self) -> list[int]:
        """Numbers of the finished updates whose rows count, in order."""
        live = self._commits()[1]
        return sorted(live, key=live.get)

    def _claim(self) -> int:
        n = max((int(name) for name in self._names("claims")), default=-1) + 1
        while not self._fs.createNewFile(self._path(f"{self.folder}/claims/{n}")):
            n += 1
        return n

    def update(self, rows: DataFrame, gone: DataFrame | None = None, key: str | None = None) -> int:
        """The rows of all files in ``rows`` are replaced, those of the files in ``gone`` (file_id) go.
        Returns the update's number, or that of the finished one with the same ``key``."""
        n = None
        if key is not None:
            n = self._commits()[0].get(self._hash(key))
            if n is not None:
                return n
        n = self._claim()
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.folder}/segments/v={n}")
        files = self.segment(n).select("file_id")
        if gone is not None:
            files = files.unionByName(gone.select("file_id"))
        files.distinct().write.mode("overwrite").parquet(f"{self.folder}/log/v={n}")
        self._fs.createNewFile(self._path(f"{self.folder}/commits/{n}.{self._hash(key) if key is not None else ''}."))
        return n

    @staticmethod
    def _hash(key: str) -> str:
        return hashlib.sha256(key.encode()).hexdigest()

    def segment(self, n: int) -> DataFrame:
        """The rows that an update wrote."""
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/segments/v={n}")

    def rows_of(self, n: int, files: DataFrame) -> DataFrame:
        """The rows of an update, or those of its ``files`` (file_id) that count now if it has been compacted."""
        if self._fs.exists(self._path(f"{self.folder}/segments/v={n}")):
            return self.segment(n)
        return self.read().join(files.distinct(), "file_id", "left_semi")

    def read(self, where: Column | None = None) -> DataFrame:
        """The rows that count; ``where`` on the column the segments are parted by prunes them. Only the
        logs of updates since the last compaction are read."""
        live = self._commits()[1]
        if not live:
            return self.spark.createDataFrame([], self.schema)
        base = f"{self.folder}/segments"
        rows = self.spark.read.option("basePath", base).schema(f"{self.schema}, v long").parquet(*(f"{base}/v={n}" for n in live))
        rows = rows if where is None else rows.where(where)
        later = [n for n, stands in live.items() if n == stands]
        if len(live) == 1:
            return rows.drop("v")
        at = f"{self.folder}/log"
        log = self.spark.read.option("basePath", at).schema("file_id long, v long").parquet(*(f"{at}/v={n}" for n in later))
        last = log.groupBy("file_id").agg(F.max("v").alias("last"))
        return rows.join(last, "file_id", "left").where("last is null or v = last").drop("v", "last")

    def compact(self) -> None:
        """One segment with the rows that count takes the place of the others."""
        live = self._commits()[1]
        if len(live) > 1:
            n = self._claim()
            writer = self.read().write.mode("overwrite")
            (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.folder}/segments/v={n}")
            self._fs.createNewFile(self._path(f"{self.folder}/commits/{n}..{max(live.values())}"))
        live, finished = self._commits()[1], {int(name.partition(".")[0]) for name in self._names("commits")}
        for part in ("segments", "log"):  # also what a compaction left that didn't come so far; not what is being written
            for name in self._names(part):
                if name.startswith("v=") and int(name[2:]) in finished - live.keys():
                    self._fs.delete(self._path(f"{self.folder}/{part}/{name}"), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)


PLACED = "file_id long, ordinal int, len int, token string, places array<int>"


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of each text (file_id, ordinal, tokens), with its places in order."""
    for batch in batches:
        tokens = batch.column(2)
        size = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
        coded = tokens.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        key = row * (len(coded.dictionary) + 1) + np.asarray(coded.indices)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        at = pa.array(row[order[first]])
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
        token = coded.dictionary.take(coded.indices.take(pa.array(order[first])))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(size[row[order[first]]], pa.int32()), token, places], names=["file_id", "ordinal", "len", "token", "places"])


class Postings:
    """The words of texts (file_id, ordinal, text), kept: a query reads only the buckets of its own
    words. ``stems`` is fixed for an index."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, stems: bool = False):
        self.stems = stems
        self.words = Kept(spark, f"{folder}/words", "file_id long, ordinal int, len int, token string, places array<int>, bucket int", by="bucket")
        self.sizes = Kept(spark, f"{folder}/sizes", "file_id long, chunks long, tokens long, digest long")

    def _tokens(self, texts: DataFrame) -> DataFrame:
        return texts.select("file_id", "ordinal", S._tokens(F.col("text"), self.stems).alias("tokens"))

    @staticmethod
    def bucket(token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(Postings.BUCKETS)).cast("int")

    def update(self, texts: DataFrame, gone: DataFrame | None = None, key: str | None = None) -> None:
        """All texts of the files in ``texts`` are replaced."""
        own = self._tokens(texts)
        # the words of a text are one row, so nothing is shuffled to bring them together
        words = own.select(F.col("file_id").cast("long").alias("file_id"), F.col("ordinal").cast("int").alias("ordinal"), "tokens").mapInArrow(placed, PLACED)
        words = words.withColumn("bucket", self.bucket(F.col("token"))).repartition("bucket", F.pmod(F.xxhash64("file_id"), F.lit(8))).sortWithinPartitions("bucket", "token")
        touched = texts.select("file_id") if gone is None else texts.select("file_id").unionByName(gone.select("file_id"))
        self.words.update(words, touched, key)
        sized = texts.select("file_id", F.xxhash64("ordinal", "text").alias("d"), F.size(S._tokens(F.col("text"), self.stems)).alias("len"))
        self.sizes.update(sized.groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("len").alias("tokens"), F.bit_xor("d").alias("digest")), gone, key)

    def bm25(self, queries: DataFrame, keys: list[str]) -> DataFrame:
        """As ``search.bm25`` over the kept words."""
        phrases = S.query_phrases(queries, self.stems)
        parts = S.parts_of(phrases)
        # BUCKETS numbers at most
        buckets = [r[0] for r in parts.select(self.bucket(F.col("token"))).distinct().collect()]
        held = self.words.read(F.col("bucket").isin(buckets)).join(S.small(parts), "token")
        at = held.select(*keys, "len", "phrase", "n", "k", F.explode("places").alias("pos"))
        stats = self.sizes.read().agg(F.sum("chunks").alias("n"), (F.sum("tokens") / F.sum("chunks")).alias("avg_len"))
        return S.score(S.held(at, keys), keys, phrases, stats)

    def drift(self, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(files whose words aren't those of ``texts``, files that ``texts`` no longer hold), each (file_id)."""
        now = texts.groupBy("file_id").agg(F.bit_xor(F.xxhash64("ordinal", "text")).alias("now"), F.count("*").alias("n"))
        both = now.join(self.sizes.read(), "file_id", "full_outer")
        stale = both.where("now is not null and not (now <=> digest and n <=> chunks)").select("file_id")
        return stale, both.where("now is null").select("file_id")

    def backfill(self, texts: DataFrame) -> int:
        """Brings the index up to ``texts``; how many files it took. An index that agrees stays as it is."""
        stale, gone = self.drift(texts)
        n = stale.count() + gone.count()
        if n:
            self.update(texts.join(stale, "file_id", "left_semi"), gone)
        return n

    def compact(self) -> None:
        self.words.compact()
        self.sizes.compact()


def text_chunks(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, text) of (file_id, text)."""
    own = files.select("file_id", T.split_words(F.col("text")).alias("words"))
    return own.select("file_id", F.posexplode(T.chunks(F.col("words"))).alias("ordinal", "text"))
