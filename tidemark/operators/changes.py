"""Keyed merges, deletions and change detection on the file, chunk and vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_files(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` replace those of the same path; id, folder and suffix of a known path stay."""
    keep = ["file_id", "folder", "ext"]
    old = base.select("path", *[F.col(c).alias(f"__{c}") for c in keep])
    merged = updates.join(old, "path", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(updates.select("path"), "path", "left_anti").select(*base.columns).unionByName(merged)


def replace_chunks(base: DataFrame, updates: DataFrame) -> DataFrame:
    """All chunks of a file in ``updates`` are replaced."""
    return base.join(updates.select("file_id").distinct(), "file_id", "left_anti").select(*base.columns).unionByName(updates.select(*base.columns))


def last_writer(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def delete(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key), key, "left_anti").select(*base.columns)


def orphans(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file_id"), "file_id", "left_anti")


def needs_index(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths that are new or whose time or size differs."""
    old = files.select("path", F.col("mtime").alias("__m"), F.col("size_bytes").alias("__s"))
    return listing.join(old, "path", "left").where("not (mtime <=> __m and size_bytes <=> __s)").drop("__m", "__s")


def reconcile(files: DataFrame, listing: DataFrame, rows: DataFrame) -> DataFrame:
    """(stale, orphans): files no longer listed, and rows that belong to no file once they went."""
    left = files.join(listing.select("path"), "path", "left_semi")
    stale = files.join(listing.select("path"), "path", "left_anti").agg(F.count("*").alias("stale"))
    return stale.crossJoin(orphans(rows, left).agg(F.count("*").alias("orphans")))


def repairs(files: DataFrame, listing: DataFrame) -> DataFrame:
    """(path, action): what brings ``files`` up to ``listing`` (both path, mtime, size_bytes): 'delete' for files that
    are no longer listed, 'index' for those that are new or differ. Once applied there is nothing left to do."""
    gone = files.join(listing.select("path"), "path", "left_anti").select("path", F.lit("delete").alias("action"))
    return gone.unionByName(needs_index(listing, files).select("path", F.lit("index").alias("action")))


def coalesced(events: DataFrame, seconds: int = 2) -> DataFrame:
    """The last kind of each path in each window: the batch form of debouncing."""
    at = F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds")
    return events.groupBy("path", at.alias("w")).agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n")).select("path", F.unix_timestamp("w.start").alias("start"), "kind", "n")


def free_names(rows: DataFrame, folder: str, stem: str, ext: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Names in a common folder: the second of a name gets `` (1)``, and so on. Of names already
    ``taken`` there (folder, stem, ext, n: 0 for the plain name), the numbers are left out."""
    r = F.row_number().over(Window.partitionBy(folder, stem, ext).orderBy(order)) - 1
    if taken is None:
        named = rows.withColumn("__n", r)
    else:
        by = [folder, stem, ext]
        used = taken.groupBy(*by).agg(F.array_sort(F.collect_set("n")).alias("__used"))
        free = lambda own, n: F.element_at(F.filter(F.sequence(F.lit(0), n + F.size(own)), lambda i: ~F.array_contains(own, i)), n + 1)
        named = rows.withColumn("__r", r).join(used, by, "left")
        named = named.withColumn("__n", F.when(F.col("__used").isNull(), F.col("__r")).otherwise(free(F.col("__used"), F.col("__r")))).drop("__used", "__r")
    n = F.col("__n")
    return named.withColumn("dest", F.concat(F.col(stem), F.when(n > 0, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(""), F.col(ext))).drop("__n")


def purge(path_rows: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, thumbnails: DataFrame) -> dict[str, DataFrame]:
    """All that belongs to the files of ``path_rows`` (path) goes: their rows, chunks, vectors and
    thumbnails (name). Returns what is left of each table."""
    gone = files.join(path_rows.select("path").distinct(), "path", "left_semi").select("file_id", "path")
    names = path_rows.select(F.concat(F.sha1("path"), F.lit(".jpg")).alias("name")).distinct()
    left = {name: delete(table, gone, "file_id") for name, table in (("files", files), ("chunks", chunks), ("vectors", vectors))}
    return left | {"thumbnails": thumbnails.join(names, "name", "left_anti")}


def compact(spark: SparkSession, folder: str, files: int, keys: list[str]) -> None:
    """The table in ``folder`` in that many files, sorted by ``keys``. The new files are whole, and the old
    ones kept under another name, before the new ones take theirs; a call that finds the name empty, as
    one before it was lost between the two, gives it to the whole table first."""
    fs, path = _fs(spark, folder)
    folder = folder.rstrip("/")
    fresh, old = f"{folder}.compact", f"{folder}.old"
    if not fs.exists(path(folder)):
        fs.rename(path(old), path(folder))
    rows = spark.read.parquet(folder)
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(fresh)
    fs.delete(path(old), True)
    for source, target in ((folder, old), (fresh, folder)):
        if not fs.rename(path(source), path(target)):
            raise OSError(f"{source} can't take the name {target}; {fresh} and {old} hold the rows")
    fs.delete(path(old), True)


def prefixes(path: Column) -> Column:
    """The path and every folder above it, without their last slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def under_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, ...) with each of ``roots`` (root) that is their path or a folder above it. A row
    for each folder of a path is joined by equality, so any number of roots will do."""
    return files.withColumn("root", F.explode(prefixes(F.col("path")))).join(roots.select("root").distinct(), "root", "left_semi")


def wipe(spark: SparkSession, *folders: str) -> int:
    """Deletes tables; how many there were."""
    fs, path = _fs(spark, folders[0])
    return sum(bool(fs.delete(path(f), True)) for f in folders)


def usage(spark: SparkSession, **folders: str) -> DataFrame:
    """(name, bytes): the sizes of folders and their sum, ``total``; what doesn't exist has none."""
    sizes = {}
    for name, folder in folders.items():
        fs, path = _fs(spark, folder)
        sizes[name] = int(fs.getContentSummary(path(folder)).getLength()) if fs.exists(path(folder)) else 0
    return spark.createDataFrame([*sizes.items(), ("total", sum(sizes.values()))], "name string, bytes long")


def append_record(spark: SparkSession, folder: str, **fields: object) -> None:
    """One more row in an append-only table of records."""
    spark.createDataFrame([fields]).coalesce(1).write.mode("append").parquet(folder)


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
