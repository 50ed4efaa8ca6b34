"""Storage reports, duplicates, latency percentiles and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranks import frames, positions


def exclusive_quantile(values: Column, i: int) -> Column:
    """The i-th of 20 exclusive quantiles of a sorted array; a single value is its own."""
    n = F.size(values)
    j = F.greatest(F.least(F.floor(i * (n + 1) / 20).cast("int"), n - 1), F.lit(1))
    d = i * (n + 1) - 20 * j
    between = (F.get(values, j - 1) * (20 - d) + F.get(values, j) * d) / 20
    return F.when(n == 1, F.get(values, F.lit(0))).otherwise(between)


def latency(samples: DataFrame, last: int = 100, by: str | None = None) -> DataFrame:
    """count, p50 and p95 over the last samples (ms, ts, event_id), of each group if asked for."""
    keys = [by] if by else []
    if by:
        order = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
        recent = samples.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= last)
    else:
        recent = samples.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    sorted_ = recent.groupBy(*keys).agg(F.sort_array(F.collect_list("ms")).alias("a"))  # at most ``last`` values a group
    return sorted_.select(*keys, F.size("a").alias("n"), F.round(exclusive_quantile(F.col("a"), 10), 1).alias("p50"), F.round(exclusive_quantile(F.col("a"), 19), 1).alias("p95"))


def duplicates(rows: DataFrame, cap: int = 50 << 20) -> DataFrame:
    """(file_id, size, digest, copy) of files whose size and content occur more than once;
    ``copy`` 0 is kept. Contents are hashed only where the size repeats, up to ``cap`` bytes."""
    sized = rows.where("size_bytes > 0")
    again = sized.groupBy("size_bytes").agg(F.count("*").alias("n")).where("n > 1").select("size_bytes")
    hashed = sized.join(again, "size_bytes", "left_semi").select("file_id", "size_bytes", F.sha2(F.substring(F.col("text").cast("binary"), 1, cap), 256).alias("digest"))
    same = hashed.groupBy("size_bytes", "digest").agg(F.count("*").alias("n"), F.min("file_id").alias("kept")).where("n > 1")
    return hashed.join(same, ["size_bytes", "digest"]).select("file_id", "size_bytes", "digest", (F.col("file_id") != F.col("kept")).cast("int").alias("copy"))


def breakdown(files: DataFrame, by: str, top: int | None = None) -> DataFrame:
    out = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("bytes"), by)
    return out.limit(top) if top else out


def cards(files: DataFrame, copies: DataFrame, now: float, large: int, stale_days: int = 365, archive_days: int = 180) -> DataFrame:
    """Suggestions that apply, one row each: position, reason, files, bytes."""
    age = (F.lit(now) - F.col("mtime")) / 86400
    tests = [("large", F.col("size_bytes") >= large), ("stale", age > stale_days), ("archives", F.col("kind").isin("archive", "disk-image") & (age > archive_days))]
    one = files.agg(*[x for name, t in tests for x in (F.count_if(t).alias(f"{name}_n"), F.coalesce(F.sum(F.when(t, F.col("size_bytes"))), F.lit(0)).alias(f"{name}_b"))])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("reason"), F.col(f"{n}_n").alias("files"), F.col(f"{n}_b").alias("bytes")) for i, (n, _) in enumerate(tests)])))
    extra = copies.where("copy = 1").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).select(F.lit(3).alias("position"), F.lit("duplicates").alias("reason"), "files", "bytes")
    return rows.unionByName(extra).where("files > 0")


def folder_kinds(files: DataFrame) -> DataFrame:
    """(folder, files, bytes, kinds): ``kinds`` maps each kind in the folder to its count."""
    flat = files.groupBy("folder", "kind").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return flat.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))


def reclaimable(copies: DataFrame, cap: int = 50 << 20) -> DataFrame:
    """One row: bytes that go when of each group of copies only the kept one stays."""
    return copies.agg(F.coalesce(F.sum(F.when(F.col("copy") == 1, F.least(F.col("size_bytes"), F.lit(cap)))), F.lit(0)).alias("bytes"))


def nearest_rank(samples: DataFrame, by: str, value: str, **quantiles: float) -> DataFrame:
    """(by, name of each quantile): the value at place round-half-even(q (n - 1)) of each group in
    order. Groups may be of any size: no task holds one."""
    own = samples.where(F.col(value).isNotNull()).select(by, value)
    n = samples.groupBy(by).agg(F.count(value).alias("n"))
    placed = positions(own, [by], F.col(value), name="r")
    at = placed.join(n, by)
    picks = [F.max(F.when(F.col("r") == F.bround(F.lit(q) * (F.col("n") - 1)), F.col(value))).alias(name) for name, q in quantiles.items()]
    return at.groupBy(by).agg(*picks)


def rolling_mean(samples: DataFrame, by: str, value: str, order: list[str], last: int) -> DataFrame:
    """``samples`` with ``mean`` and ``n`` of the last rows of their group up to each; groups may be of any size."""
    placed = positions(samples, [by], *map(F.col, order), name="__r")
    return frames(placed, [by], "__r", last - 1, mean=lambda w: F.avg(value).over(w), n=lambda w: F.count("*").over(w)).drop("__r")


def recall(got: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of each query's k true rows (query_id, file_id) among those got."""
    hit = truth.join(got.select("query_id", "file_id", F.lit(1).alias("hit")), ["query_id", "file_id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / float(k)).alias("recall"))


def reciprocal_ranks(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (queries, mrr, top1, top3, top5): ``hits`` (query_id, rank) of relevant rows; a query
    without one counts as 0."""
    first = queries.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    within = [F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 6).alias(f"top{k}") for k in (1, 3, 5)]
    return first.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), *within)


def repeats(samples: DataFrame, by: str, seconds: str, items: str) -> DataFrame:
    """(by, least, mean, rate): the least and mean time of a benchmark's repeats, and items a second at the mean."""
    return samples.groupBy(by).agg(F.min(seconds).alias("least"), F.avg(seconds).alias("mean"), (F.avg(items) / F.avg(seconds)).alias("rate"))
