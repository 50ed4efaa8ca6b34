"""Exact nearest neighbours by cosine of many queries: every query against every vector, as products of matrices.

Vectors are dealt to parts and queries to blocks, both of bounded size, and each part meets each block in a
group of its own, which keeps the best ``k`` of each query. So the work is that of all pairs, spread over the groups; no task
holds more than a part, a block and a tile of their scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors in a part, queries in a block at most, queries in a block if there are many blocks only to keep all cores busy; scores in a tile.
PART, BLOCK, LEAST, TILE = 1 << 16, 1 << 14, 256, 1 << 22


def unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of length one, zero vectors as they are, and which of them are null, hold a null or aren't as long as most."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), -1))
    wide = int(np.bincount(sizes[sizes >= 0]).argmax()) if (sizes >= 0).any() else 0
    bad = sizes != wide
    flat = lists.filter(pa.array(~bad)).flatten()
    rows = np.full((len(sizes), wide), 0.0)
    rows[~bad] = np.asarray(pa.compute.fill_null(flat, 0.0), np.float64).reshape(-1, wide)
    if flat.null_count:
        bad[np.flatnonzero(~bad)[np.asarray(flat.is_null()).reshape(-1, wide).any(axis=1)]] = True
    norms = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore"):
        return rows / np.where(norms > 0, norms, np.where(np.isnan(norms), norms, 1.0)), bad


def best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of each row of ``keys``, the first of equals, in order."""
    if keys.shape[1] > k:
        least = -np.partition(-keys, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(keys >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(keys.shape))
    order = np.lexsort((column, -keys[row, column], row))
    row, column = row[order], column[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], column[keep]


def cosines(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, file_id, ordinal, score, rank): the ``k`` nearest of ``vectors`` (file_id, ordinal, vec) for each of ``queries``
    (query_id, query_vec), by cosine to nine places, ties to the lesser file and ordinal. Vectors of another length than most, null or
    holding a null have no score and come last."""
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("vec"))
    own = vectors.select(F.col("file_id").cast("long").alias("file_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("vec").cast("array<double>").alias("vec"))
    n, m = own.count(), asked.count()
    parts = max(1, -(-n // PART))
    spread = min(-(-spark.sparkContext.defaultParallelism // parts), -(-m // LEAST))
    blocks = max(1, -(-m // BLOCK), spread)
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    rows = own.withColumn("part", F.pmod(F.xxhash64("file_id", "ordinal"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("file_id", "ascending"), ("ordinal", "ascending")])
        file, ordinal, ids = left.column("file_id").to_numpy(), left.column("ordinal").to_numpy(), right.column("query_id").to_numpy()
        found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int32, np.float64, np.bool_)]
        if len(file) and len(ids):
            (held, bad), (asking, odd) = unit(left.column("vec")), unit(right.column("vec"))
            if held.shape[1] != asking.shape[1]:
                asking, odd = np.zeros((len(asking), held.shape[1])), np.ones(len(asking), bool)
            step = max(1, TILE // len(file))
            for at in range(0, len(ids), step):
                score = np.round(asking[at : at + step] @ held.T, 9)
                without = bad[None] | odd[at : at + step, None]
                row, column = best(np.where(without, -np.inf, np.where(np.isnan(score), np.inf, score)) if without.any() or np.isnan(score).any() else score, k)
                for out, x in zip(found, (ids[at + row], file[column], ordinal[column], score[row, column], np.broadcast_to(without, score.shape)[row, column]), strict=True):
                    out.append(x)
        query, files, places, scores, none = (np.concatenate(x) for x in found)
        return pa.table({"query_id": query, "file_id": files, "ordinal": places, "score": pa.array(scores, pa.float64(), mask=none)})

    near = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(nearest, "query_id long, file_id long, ordinal int, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id", "ordinal"))
    return near.withColumn("rank", place).where(F.col("rank") <= k)
