"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Training. Coarse centroids (cells) and, for what is left of a vector beside its cell's centroid,
a codebook for each group of ``WIDTH`` dimensions are found by Lloyd's rounds over a bounded sample
(``SAMPLE`` vectors); a round is one job of partial sums. How many cells a query has to read is
measured on a bounded sample of the vectors themselves.

Lists. Every vector is kept with its cell and code, parted by cell and changed by file like all
kept tables, so an update is found at once and a search reads the cells its queries reach.

Search. Cells are dealt to shelves of about ``PART`` vectors; a cell that is much larger than others is
parted, so one that holds a third of all vectors is many groups. A group meets the queries that reach one of its
cells: a cell's quantised vectors and its queries are one product, and each query's best are scored
again from the original vectors. So a group gives ``k`` rows a query, whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import nearest as N
from tidemark.operators import search as S
from tidemark.sources.store import Kept

SAMPLE, ROUNDS, MOST_CELLS = 1 << 16, 8, 4096
WIDTH, CODES = 2, 256
#: Vectors in one group of cells, about, and candidates that are scored exactly for each result wanted.
PART, REFINE = 1 << 16, 10
#: Queries in one group at most, and that many at least if there are more groups only to keep all cores busy; queries scored at once.
ASKED, LEAST, TILE = 1 << 14, 256, 32
#: Vectors that the number of cells to read is measured with.
PROBED = 200
LISTS = "file_id long, ordinal int, code binary, vec array<double>, cell int"


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix; of length one each, zero vectors as they are."""
    flat = np.asarray(column.flatten(), np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def grouped(rows: np.ndarray) -> np.ndarray:
    """(rows, groups, WIDTH): the dimensions in groups, filled with zeros."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % WIDTH))).reshape(len(rows), -1, WIDTH)


def closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroid next to each point, the first of equals."""
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * points @ centroids.T, axis=1)


class Trained:
    """Centroids of cells and codebooks; bounded by ``MOST_CELLS`` and ``CODES`` rows of a vector's length."""

    def __init__(self, cells: np.ndarray, books: np.ndarray | None = None):
        self.cells, self.books = cells, books

    def cell(self, rows: np.ndarray) -> np.ndarray:
        step = max(1, (1 << 22) // len(self.cells))
        return np.concatenate([closest(rows[i : i + step], self.cells) for i in range(0, len(rows), step)] or [np.zeros(0, np.int64)])

    def code(self, rows: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = grouped(rows - self.cells[cell])
        return np.stack([closest(rest[:, g], self.books[g]) for g in range(rest.shape[1])], axis=1).astype(np.uint8)

    def decoded(self, code: np.ndarray) -> np.ndarray:
        """What codes stand for, beside the cells' centroids."""
        return self.books[np.arange(code.shape[1]), code].reshape(len(code), -1)


def _sums(assign, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (g, k, n, total) of a partition for each centroid; ``assign`` gives points (rows, groups, width) and numbers.
    A batch is added up in as many passes as points are wide, however many centroids there are."""
    count, sums = np.zeros((1, 0), np.int64), np.zeros((1, 0, 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        points, numbers = assign(matrix(batch.column(0)))
        _, groups, width = points.shape
        most = max(count.shape[1], int(numbers.max()) + 1)
        flat = (numbers + most * np.arange(groups)).ravel()
        n = np.bincount(flat, minlength=groups * most).reshape(groups, most)
        total = np.stack([np.bincount(flat, points[:, :, i].ravel(), groups * most) for i in range(width)], axis=-1).reshape(groups, most, width)
        n[:, : count.shape[1]] += count
        total[:, : count.shape[1]] += sums
        count, sums = n, total
    g, k = np.nonzero(count)
    columns = [pa.array(g, pa.int32()), pa.array(k, pa.int32()), pa.array(count[g, k], pa.int64()), pa.array(list(sums[g, k]), pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["g", "k", "n", "total"])


def _lloyd(sample: DataFrame, start: np.ndarray, assign) -> np.ndarray:
    """``start`` (groups, centroids, width) moved to the means of what is assigned to them; centroids
    that nothing is assigned to stay."""
    now = start.copy()
    for _ in range(ROUNDS):
        before = now.copy()
        parts = sample.mapInArrow(partial(_sums, partial(assign, now)), "g int, k int, n long, total array<double>")
        # a row for each centroid and dimension group, whatever the sample
        summed = parts.groupBy("g", "k").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(now.shape[2])])
        for r in summed.collect():
            now[r.g, r.k] = np.array([r[f"s{i}"] for i in range(now.shape[2])]) / r.n
        if np.allclose(now, before, rtol=0, atol=1e-9):
            break
    return now


def _to_cells(now: np.ndarray, rows: np.ndarray):
    return rows[:, None], Trained(now[0]).cell(rows)[:, None]


def _to_codes(cells: np.ndarray, now: np.ndarray, rows: np.ndarray):
    own = Trained(cells, now)
    cell = own.cell(rows)
    return grouped(rows - cells[cell]), own.code(rows, cell).astype(np.int64)


def train(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> Trained:
    """``vectors``: (file_id, ordinal, vec). Cells: the root of the number of vectors if not given."""
    usable = vectors.select(F.col("vec").cast("array<double>").alias("vec"), F.xxhash64("file_id", "ordinal", F.lit(seed)).alias("drawn")).where("vec is not null and size(vec) > 0")
    total = usable.count()
    if not total:
        raise ValueError("no vectors to train on")
    sample = usable.orderBy("drawn").limit(SAMPLE).repartition(usable.sparkSession.sparkContext.defaultParallelism).cache()
    n = max(1, min(cells or int(total**0.5), MOST_CELLS, total))
    first = matrix(pa.array([r.vec for r in sample.orderBy("drawn").limit(max(n, CODES)).collect()], pa.list_(pa.float64())))
    own = Trained(_lloyd(sample, first[:n][None], _to_cells)[0])
    rest = grouped(first - own.cells[own.cell(first)])
    start = np.stack([np.resize(rest[:, g], (CODES, WIDTH)) for g in range(rest.shape[1])])
    own.books = _lloyd(sample, start, partial(_to_codes, own.cells))
    sample.unpersist()
    return own


def scores(asking: np.ndarray, vectors: np.ndarray, columns: np.ndarray, asks: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Products of ``asking`` with the rows ``columns`` of ``vectors``, minus infinity where a query doesn't ask (``asks``) the list of the
    vector. Lists are stretches of ``vectors``; ``columns`` are all rows of those that some query asks. One product of all if
    queries ask for half of it at least, else one a list."""
    used = np.flatnonzero(asks.any(axis=0))
    if 2 * (asks @ sizes).sum() >= len(asking) * len(columns):
        out = asking @ (vectors if len(columns) == len(vectors) else vectors[columns]).T
        out[np.repeat(~asks[:, used], sizes[used], axis=1)] = -np.inf
        return out
    out, end = np.full((len(asking), len(columns)), -np.inf, vectors.dtype), 0
    for i in used:
        own, begin, end = np.flatnonzero(asks[:, i]), end, end + sizes[i]
        out[own, begin:end] = asking[own] @ vectors[begins[i] : begins[i] + sizes[i]].T
    return out


class VectorIndex:
    """Vectors (file_id, ordinal, vec) below ``folder``, by cells. ``probes``: the cells a query reads,
    measured by ``build`` unless given."""

    def __init__(self, spark: SparkSession, folder: str, trained: Trained, probes: int | None = None):
        self.spark, self.trained, self.probes = spark, trained, probes
        self.lists = Kept(spark, f"{folder}/lists", LISTS, by="cell")

    @classmethod
    def build(cls, spark: SparkSession, folder: str, vectors: DataFrame, cells: int | None = None, probes: int | None = None, recall: float = 0.97, k: int = 10) -> VectorIndex:
        """Trains on ``vectors``, indexes all of them and measures ``probes``: the fewest cells that hold
        ``recall`` of the true ``k`` nearest of ``PROBED`` of the vectors."""
        own = cls(spark, folder, train(vectors, cells), probes)
        own.update(vectors)
        if probes is None:
            own.probes = own._measure(recall, k)
        held = [(-2, own.probes, []), *((-1, i, c.tolist()) for i, c in enumerate(own.trained.cells)), *((g, i, c.tolist()) for g, b in enumerate(own.trained.books) for i, c in enumerate(b))]
        spark.createDataFrame(held, "g int, k int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/trained")
        return own

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        """The index that ``build`` left below ``folder``."""
        held = spark.read.parquet(f"{folder}/trained").orderBy("g", "k").collect()
        cells = np.array([r.centroid for r in held if r.g == -1])
        books = np.array([r.centroid for r in held if r.g >= 0]).reshape(-1, CODES, WIDTH)
        return cls(spark, folder, Trained(cells, books), held[0].k)

    def compact(self) -> None:
        self.lists.compact()

    def update(self, vectors: DataFrame, gone: DataFrame | None = None, key: str | None = None) -> int:
        """All vectors of the files in ``vectors`` are replaced, those of ``gone`` (file_id) go. Null and empty
        vectors take no part; all others have the length that the index was trained with."""
        trained = self.trained

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = matrix(batch.column(2))
                cell = trained.cell(rows)
                code = trained.code(rows, cell) if len(rows) else np.zeros((0, 1), np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes() for c in code], pa.binary()), batch.column(2), pa.array(cell, pa.int32())], names=["file_id", "ordinal", "code", "vec", "cell"])

        rows = vectors.select(F.col("file_id").cast("long").alias("file_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("vec").cast("array<double>").alias("vec"))
        touched = rows.select("file_id") if gone is None else rows.select("file_id").unionByName(gone.select("file_id"))
        return self.lists.update(rows.where("vec is not null and size(vec) > 0").mapInArrow(coded, LISTS).hint("rebalance", "cell"), touched, key)

    def _reached(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, vec, cell, place): the cells next to each query, from 0."""
        cells = self.trained.cells

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = np.argsort(-(matrix(batch.column(1)) @ cells.T), axis=1, kind="stable")[:, :probes]
                n = order.shape[1]
                take = pa.array(np.repeat(np.arange(len(order)), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(order.ravel(), pa.int32()), pa.array(np.tile(np.arange(n), len(order)), pa.int32())], names=["query_id", "vec", "cell", "place"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0")
        return asked.mapInArrow(near, "query_id long, vec array<double>, cell int, place int")

    def _measure(self, recall: float, k: int) -> int:
        held = self.lists.read()
        asked = held.orderBy(F.xxhash64("file_id", "ordinal", F.lit(3))).limit(PROBED)
        asked = asked.select(F.row_number().over(S.Window.orderBy("file_id", "ordinal")).alias("query_id"), F.col("vec").alias("query_vec"))  # PROBED rows
        true = N.cosines(held, asked, k)
        cells = true.join(held.select("file_id", "ordinal", "cell"), ["file_id", "ordinal"])
        places = cells.join(self._reached(asked, len(self.trained.cells)).select("query_id", "cell", "place"), ["query_id", "cell"])
        return int(places.agg(F.percentile("place", recall)).first()[0] or 0) + 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = REFINE) -> DataFrame:
        """(query_id, file_id, ordinal, score, rank): for each of ``queries`` (query_id, query_vec) the
        ``k`` nearest that its cells hold, with exact scores; ties go to the lesser file and ordinal."""
        probes = probes or self.probes or len(self.trained.cells)
        trained, most = self.trained, k * refine
        cells = trained.cells
        held = self.lists.read()
        # a number for each cell at most
        sizes = {r.cell: r.n for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        shelves = max(1, -(-sum(sizes.values()) // PART))
        part = max(1, PART * shelves // len(cells))
        parts = np.array([-(-sizes.get(c, 0) // part) for c in range(len(cells))])
        m = queries.count()
        blocks = max(1, -(-m // ASKED), min(-(-self.spark.sparkContext.defaultParallelism // shelves), -(-m // LEAST)))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and group of vectors that holds one of its cells."""
            for batch in batches:
                order = np.argsort(-(matrix(batch.column(1)) @ cells.T), axis=1, kind="stable")[:, :probes]
                row, shelf, of, own = [], [], [], []
                for i, near in enumerate(order):
                    near = near[parts[near] > 0]
                    for at in np.unique(near % shelves).tolist():
                        here = near[near % shelves == at]
                        for p in range(parts[here].max()):
                            row.append(i), shelf.append(at), of.append(p), own.append(here[parts[here] > p].tolist())
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(shelf, pa.int32()), pa.array(of, pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["query_id", "vec", "shelf", "part", "cells"])

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<double>").alias("vec")).where("vec is not null and size(vec) > 0")
        asked = asked.repartition(self.spark.sparkContext.defaultParallelism).mapInArrow(reach, "query_id long, vec array<double>, shelf int, part int, cells array<int>")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        few = F.broadcast(self.spark.createDataFrame([(c, int(n)) for c, n in enumerate(parts) if n], "cell int, parts int"))
        rows = held.join(few, "cell").withColumn("shelf", F.pmod("cell", F.lit(shelves)).cast("int")).withColumn("part", F.pmod(F.xxhash64("file_id", "ordinal"), F.col("parts")).cast("int"))
        rows = rows.drop("parts").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def best(own: pa.Table, questions: pa.Table) -> pa.Table:
            found: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int32, np.float64)]
            if own.num_rows and questions.num_rows:
                own = own.sort_by([("cell", "ascending"), ("file_id", "ascending"), ("ordinal", "ascending")])
                file, ordinal, cell = (own.column(c).to_numpy() for c in ("file_id", "ordinal", "cell"))
                vectors, codes = matrix(own.column("vec").combine_chunks()), np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(own.num_rows, -1)
                # the quantised vectors themselves, in single precision as they only choose what is scored exactly
                coarse = (cells[cell] + trained.decoded(codes)[:, : vectors.shape[1]]).astype(np.float32)
                asking, ids = matrix(questions.column("vec").combine_chunks()), questions.column("query_id").to_numpy()
                wanted = questions.column("cells").to_pylist()
                single = asking.astype(np.float32)
                here, begins, sizes = np.unique(cell, return_index=True, return_counts=True)
                lists, place = np.repeat(np.arange(len(here)), sizes), {c: i for i, c in enumerate(here.tolist())}
                order = np.argsort([w[0] for w in wanted], kind="stable")
                for at in range(0, len(order), TILE):
                    some = order[at : at + TILE]
                    asks = np.zeros((len(some), len(here)), bool)
                    for j, q in enumerate(some):
                        asks[j, [place[c] for c in wanted[q] if c in place]] = True
                    used = asks.any(axis=0)
                    if not used.any():
                        continue
                    columns = np.flatnonzero(used[lists])
                    score = scores(single[some], coarse, columns, asks, begins, sizes)
                    near = np.argpartition(score, len(columns) - most, axis=1)[:, len(columns) - most :] if len(columns) > most else np.tile(np.arange(len(columns)), (len(some), 1))
                    reached = np.take_along_axis(score, near, axis=1) > -np.inf
                    near = columns[near]
                    exact = np.where(reached, np.round(np.einsum("qnd,qd->qn", vectors[near], asking[some]), 9), -np.inf)
                    ranks = np.lexsort((ordinal[near], file[near], -exact), axis=1)[:, :k]
                    exact, near = np.take_along_axis(exact, ranks, axis=1), np.take_along_axis(near, ranks, axis=1)
                    row, column = np.nonzero(exact > -np.inf)
                    for out, x in zip(found, (ids[some[row]], file[near[row, column]], ordinal[near[row, column]], exact[row, column]), strict=True):
                        out.append(x)
            query, files, places, values = (np.concatenate(x) for x in found)
            return pa.table({"query_id": query, "file_id": files, "ordinal": places, "score": values})

        keys = ["shelf", "part", "block"]
        near = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query_id long, file_id long, ordinal int, score double")
        return S.top_k(near, k, F.desc("score"), F.asc("file_id"), F.asc("ordinal"))
