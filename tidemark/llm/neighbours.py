"""Nearest neighbours by inner product: stable projections under a kd-tree.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M the greatest norm, and a query (q, 0): then
the nearest by Euclidean distance is the greatest inner product. ``DIMENSIONS`` Gaussian
(2-stable) projections keep distances in distribution: projected squared distance over
true squared distance follows chi-square (their directions are made orthogonal, which keeps
the mean and narrows both tails, so the test errs on the safe side). So neighbours are met in
the order of their projected distance and verified on the original vectors, until the next
projected distance is so large that a vector as near as the k-th found would lie beyond it with
probability 1 - ``CERTAIN`` at most. A leaf is met as a whole; of its points only those the
test doesn't rule out are verified.

Two levels. The upper part of the kd-tree, fitted on a bounded sample, deals all rows to
cells; a query first searches its own cell, and then those cells whose box its stopping
test hasn't ruled out, found by descent from the root. Inside a cell, chunks of bounded size
carry a kd-tree of their own, whose leaves are visited nearest first. Queries are dealt in
blocks of bounded size.
Rows with equal vectors are kept as far as they can be among the k nearest of a query:
the k+1 least ids, which decides all ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import Scratch

DIMENSIONS, CERTAIN, SEED = 24, 0.8, 77
#: Rows of the sample the cells are fitted on at most; rows in a cell, chunk, leaf and block of queries; cells at most.
SAMPLE, CELL, CHUNK, LEAF, BLOCK, MOST_CELLS = 32_768, 8_192, 16_384, 64, 1_024, 65_536


def chi_square_below(x: float, m: int) -> float:
    """P(X <= x) for chi-square with an even number m of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, m) < p else (low, mid)
    return high


def directions(d: int) -> np.ndarray:
    """An even number of columns, DIMENSIONS at most, for vectors of length d and their lift."""
    m = max(2, min(DIMENSIONS, d + 1) // 2 * 2)
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((d + 1, m)))[0] * math.sqrt(d + 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def kd_splits(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A complete kd-tree in heap order: (axis, value) of each inner node; ``leaves`` a power of two."""
    nodes: list[tuple[int, float]] = []
    groups = [points]
    while len(groups) < leaves:
        below = []
        for g in groups:
            axis = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            value = float(np.median(g[:, axis])) if len(g) else 0.0
            nodes.append((axis, value))
            right = g[:, axis] > value if len(g) else np.zeros(0, bool)
            below += [g[~right], g[right]]
        groups = below
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    axis, value = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes])
    for _ in range((len(nodes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > value[at])
    return at - len(nodes)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for k in range(points.shape[1]):
        p = points[:, k : k + 1]
        gap = np.maximum(0, np.maximum(low[:, k] - p, p - high[:, k]))
        out += gap * gap
    return out


class Boxes:
    """The cells' bounding boxes under the inner nodes of their kd-tree; cells without rows have none."""

    def __init__(self, leaves: int, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.first = leaves - 1
        self.low, self.high = np.full((2 * leaves - 1, low.shape[1]), np.inf), np.full((2 * leaves - 1, low.shape[1]), -np.inf)
        self.low[self.first + cells], self.high[self.first + cells] = low, high
        for node in range(self.first - 1, -1, -1):
            self.low[node] = np.minimum(self.low[2 * node + 1], self.low[2 * node + 2])
            self.high[node] = np.maximum(self.high[2 * node + 1], self.high[2 * node + 2])

    def _near(self, points: np.ndarray, reach: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        found = []
        for at in range(0, len(q), 1 << 16):
            own, boxes = q[at : at + (1 << 16)], node[at : at + (1 << 16)]
            gap = np.maximum(0, np.maximum(self.low[boxes] - points[own], points[own] - self.high[boxes]))
            found.append((gap * gap).sum(axis=1) <= reach[own])
        return np.concatenate(found) if found else np.zeros(0, bool)

    def within(self, points: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, cell) whose squared distance is at most the point's reach, by descent from the root."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        near = self._near(points, reach, q, node) & np.isfinite(self.low[node, 0])
        q, node = q[near], node[near]
        while len(q) and node[0] < self.first:
            q, node = np.repeat(q, 2), np.repeat(2 * node + 1, 2)
            node[1::2] += 1
            near = np.isfinite(self.low[node, 0])
            q, node = q[near], node[near]
            near = self._near(points, reach, q, node)
            q, node = q[near], node[near]
        return q, node - self.first


def search(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_points: np.ndarray, bound: np.ndarray, base: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score) of each query's k best among these vectors, as far as the
    stopping test lets it look, and how many each query verified. ``bound``: the score of a k-th
    neighbour known so far; ``base`` - 2 score is the squared distance."""
    leaves: list[np.ndarray] = [np.arange(len(ids))]
    while max(map(len, leaves)) > LEAF:
        below = []
        for own in leaves:
            if len(own) <= LEAF:
                below.append(own)
                continue
            axis = int(np.argmax(np.ptp(projected[own], axis=0)))
            half = np.argpartition(projected[own, axis], len(own) // 2)
            below += [own[half[: len(own) // 2]], own[half[len(own) // 2 :]]]
        leaves = below
    low, high = (np.stack([f(projected[own], axis=0) for own in leaves]) for f in (np.min, np.max))
    far = box_distance(query_points, low, high)
    order = np.argsort(far, axis=1, kind="stable")
    size, own_size = (projected * projected).sum(axis=1), (query_points * query_points).sum(axis=1)
    best = np.full((len(queries), k), -np.inf)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    limit, verified = bound.copy(), np.zeros(len(queries), np.int64)
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        leaf = order[active, turn]
        # the test: what lies beyond this leaf's box is too far for the k-th place
        reach = stop * np.maximum(base[active] - 2 * limit[active], 0) * (1 + 1e-12)
        go = ~(far[active, leaf] > reach)
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by])) + 1
        for own in np.split(by, cuts):
            q, rows = active[own], leaves[leaf[own[0]]]
            apart = own_size[q][:, None] + size[rows] - 2 * query_points[q] @ projected[rows].T
            slack = 1e-9 * (own_size[q][:, None] + size[rows])
            near = ~(apart - slack > stop * np.maximum(base[q] - 2 * limit[q], 0)[:, None]) & (ids[rows] != query_ids[q][:, None])
            i, j = np.nonzero(near)
            verified[q] += near.sum(axis=1)
            scores = np.full(near.shape, -np.inf)
            scores[i, j] = np.einsum("nd,nd->n", queries[q[i]], vectors[rows[j]])
            gains = scores.max(axis=1) >= best[q, -1]
            q, scores = q[gains], scores[gains]
            if not len(q):
                continue
            names = np.where(scores > -np.inf, ids[rows], np.iinfo(np.int64).max)
            scores, names = np.concatenate([best[q], scores], axis=1), np.concatenate([who[q], names], axis=1)
            top = np.lexsort((names, -scores), axis=1)[:, :k]
            best[q], who[q] = np.take_along_axis(scores, top, 1), np.take_along_axis(names, top, 1)
            limit[q] = np.maximum(limit[q], best[q, -1])
    found = np.nonzero(best > -np.inf)
    return found[0], who[found], best[found], verified


FOUND = "query_id long, vec_id long, score double, verified long"


def _search_groups(k: int, stop: float, most: float):
    def run(key: tuple, data: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score", "verified"]
        if not len(data) or not len(asked):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})
        flat = lambda t, c: _matrix(t.column(c).combine_chunks())
        queries = flat(asked, "x")
        base = most * most + (queries * queries).sum(axis=1)
        query_ids = asked.column("vec_id").to_numpy()
        q, who, score, verified = search(data.column("vec_id").to_numpy(), flat(data, "x"), flat(data, "p"), query_ids, queries, flat(asked, "p"), asked.column("bound").to_numpy(), base, k, stop)
        first = np.concatenate([[True], np.diff(q) != 0]) if len(q) else np.zeros(0, bool)  # a query's count is on one of its rows
        return pa.table({"query_id": query_ids[q], "vec_id": who, "score": score, "verified": np.where(first, verified[q], 0)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id", "score").agg(F.sum("verified").alias("verified"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, scratch: Scratch, k: int = 20, queries: str = "vec_id % 20 = 0", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_verified): for each row that ``queries`` picks, its k nearest of all
    rows but its own, by inner product in double precision; ties go to the smaller id.
    ``n_verified`` is how many vectors the query verified in all.

    Vectors that are null, empty, zero, of another length than most, or hold null or
    non-finite components take no part, nor do null ids. Rows of the query's own id are
    never its neighbours; repeated rows count once. Fewer candidates than k give fewer
    rows; an empty table none."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    length = rows.agg(F.mode(F.size("x"), True)).first()[0]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    if not length:
        return empty
    rows = rows.where(F.size("x") == length)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    most = rows.agg(F.max(norm)).first()[0]
    planes = directions(length)
    width = planes.shape[1]

    @F.arrow_udf("array<double>")
    def project(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch, query in columns:
            x = _matrix(batch)
            lift = np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0)) if len(x) else np.zeros(0)
            lift[np.asarray(query, dtype=bool)] = 0
            yield _rows(np.concatenate([x, lift[:, None]], axis=1) @ planes) if len(x) else pa.array([], pa.list_(pa.float64()))

    # equal vectors: any query's k nearest hold at most the k+1 least ids of them
    same = Window.partitionBy("x").orderBy("vec_id")
    data = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "x", project("x", F.lit(False)).alias("p"))
    data = scratch.keep(data, "data")
    asked = scratch.keep(rows.where(queries).distinct().select("vec_id", "x", project("x", F.lit(True)).alias("p")), "asked")
    total = data.count()
    if not total:
        return empty
    share = min(1.0, SAMPLE / total)
    sample = data.where(F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(1 << 20)) < int(share * (1 << 20))).select("p").limit(2 * SAMPLE).toPandas()
    points = np.stack(sample["p"].to_numpy()) if len(sample) else np.zeros((0, width))
    leaves = 1 << max(0, min(MOST_CELLS, -(-total // CELL)) - 1).bit_length() if total > CELL else 1
    nodes = kd_splits(points, leaves)

    @F.arrow_udf("long")
    def cell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(cell_of(_matrix(batch), nodes) if nodes and len(batch) else np.zeros(len(batch), np.int64))

    data = scratch.keep(data.withColumn("cell", cell("p")), "cells")
    edges = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    boxes = data.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()  # MOST_CELLS rows at most
    low = np.array([[b[f"low{i}"] for i in range(width)] for b in boxes])
    high = np.array([[b[f"high{i}"] for i in range(width)] for b in boxes])
    tree = Boxes(leaves, np.array([b.cell for b in boxes]), low, high)
    chunks = {b.cell: -(-b.n // CHUNK) for b in boxes}
    stop = chi_square_quantile(CERTAIN, width)

    @F.arrow_udf("array<bigint>")
    def further(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, p, bound, own in columns:
            if not len(x):
                yield pa.array([], pa.list_(pa.int64()))
                continue
            q = _matrix(x)
            base = most * most + (q * q).sum(axis=1)
            who, cells = tree.within(_matrix(p), stop * np.maximum(base - 2 * np.asarray(bound), 0) * (1 + 1e-12))
            other = cells != np.asarray(own)[who]
            who, cells = who[other], cells[other]
            counts = np.bincount(who, minlength=len(x))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(cells[np.argsort(who, kind="stable")]))

    sizes = spark.createDataFrame([(int(c), int(n)) for c, n in chunks.items()], "cell long, chunks long")
    data = data.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks"))

    def visit(sought: DataFrame, name: str) -> DataFrame:
        """``sought`` (vec_id, x, p, bound, cell) against all chunks of its cells."""
        load = sought.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        load = F.broadcast(scratch.keep(load, f"{name}-load"))
        here = data.join(load, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        there = sought.join(load, "cell").join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks"))
        there = there.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        by = ["cell", "chunk", "block"]
        pairs = here.select(*by, "vec_id", "x", "p").groupBy(*by).cogroup(there.select(*by, "vec_id", "x", "p", "bound").groupBy(*by))
        return scratch.keep(pairs.applyInArrow(_search_groups(k, stop, most), FOUND), name)

    least = F.lit(float("-inf"))
    first = scratch.keep(asked.select("vec_id", "x", "p", least.alias("bound"), cell("p").alias("cell")), "first")
    found = visit(first, "found")
    kth = _best(found, k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n"))
    kth = kth.where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), "score")
    second = first.join(kth, "vec_id", "left").withColumn("bound", F.coalesce("score", least))
    second = second.withColumn("cell", F.explode(further("x", "p", "bound", "cell"))).select("vec_id", "x", "p", "bound", "cell")
    second = scratch.keep(second, "second")
    found = found.union(visit(second, "found-further"))
    total = found.groupBy("query_id").agg(F.sum("verified").alias("n_verified"))
    return _best(found, k).join(total, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "n_verified")
