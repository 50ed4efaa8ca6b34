"""Quality scores: ridge regression on random Fourier features, calibrated isotonically.

Document statistics (shapes of words, marks, repetition; never labels, language, source
or id) are standardised and mapped by ``FEATURES`` random cosines, which approximate a
Gaussian kernel. Each partition sums its normal equations per fold; the sums of the
folds give the final model and, without one fold each, the models whose scores on that
fold are calibrated by pool-adjacent-violators over score bins. What reaches the driver
is bounded: at most ``PARTS`` x ``FOLDS`` small matrices and ``BINS`` bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import Words
from tidemark.llm.scratch import Scratch

FEATURES, FOLDS, PARTS, BINS, RIDGE, SEED = 192, 4, 16, 1000, 3e-3, 11
#: Labelled rows to fit on at most, picked by a hash of the id.
MAX_FIT = 2_000_000
_MARKS = b"#$%&*!|+=<>@^~_{}[]\\/"
N_STATISTICS = 19


def statistics(piece: pa.Array) -> np.ndarray:
    """A row of N_STATISTICS numbers for each text."""
    words = Words(*bytewise.buffers(piece))
    raw, ends, n = words.raw, words.ends, len(piece)
    size, count = np.diff(ends), np.diff(words.bounds)
    kind = np.zeros(256, np.uint8)
    kind[[*_MARKS]] = 1
    kind[48:58], kind[65:91], kind[97:123], kind[128:] = 2, 3, 4, 5
    kind[[*b".,;:?'\"()-"]] = 6
    kind[10] = 7
    kinds = kind[raw]

    def share(k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kinds == k)])
        return (sums[ends[1:]] - sums[ends[:-1]]).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(flags)])
        return sums[words.bounds[1:]] - sums[words.bounds[:-1]]

    chars, tokens = np.maximum(size, 1), np.maximum(count, 1)
    length = (words.stop - words.start).astype(float)
    first, last = kinds[words.start], kinds[words.stop - 1]
    hashes, owner = words.hashes(), words.text_of
    beside = np.zeros(len(words), bool)
    if len(words) > 1:
        beside[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(words))
    if len(words) > 1:
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds_of_word = np.bincount(owner, fresh, n) if len(words) else np.zeros(n)
    upper = np.concatenate([[0], np.cumsum(kinds == 3)])
    shout = (upper[words.stop] - upper[words.start]) >= np.maximum(2, length / 2)
    mean = per_text(length) / tokens
    lines = share(7) + 1
    marks = share(1)
    columns = [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per_text(length**2) / tokens - mean**2, 0)),
        marks / chars, share(2) / chars, share(3) / chars, share(5) / chars, share(6) / chars,
        np.log1p(count / lines), per_text(shout) / tokens, per_text(last == 1) / tokens, per_text((first == 1) & (length == 1)) / tokens,
        per_text(beside) / tokens, kinds_of_word / tokens, kinds_of_word / np.sqrt(tokens), per_text(last == 6) / tokens, per_text(first == 3) / tokens, np.log1p(marks),
    ]
    return np.stack(columns, axis=1)


def statistics_column():
    """A column function: text to its statistics."""

    @F.arrow_udf("array<double>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = np.concatenate([statistics(p) for p in bytewise.pieces(batch)])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * N_STATISTICS), pa.array(rows.ravel()))

    return of


@dataclass
class Fourier:
    """Standardisation and the random cosines; the last output is the constant."""

    mean: np.ndarray
    deviation: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = len(self.mean)
        directions = rng.standard_normal((d, FEATURES)) / np.sqrt(2 * d)
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((rows - self.mean) / self.deviation, -8, 8)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones((len(rows), 1))], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, N_STATISTICS)


def _partial_sums(fourier: Fourier):
    """Rows (fold, label, statistics) to one row per fold: the sums X'X and X'y as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        a, b, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS, np.int64)
        for batch in batches:
            fold, y = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            x = fourier(_matrix(batch.column(2)))
            for f in np.unique(fold):
                own = x[fold == f]
                a[f] += own.T @ own
                b[f] += own.T @ y[fold == f]
                n[f] += len(own)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array([a[f].tobytes() for f in used], pa.binary()), pa.array([b[f].tobytes() for f in used], pa.binary())], names=["fold", "n", "a", "b"])

    return run


def solve(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    penalty = np.full(len(b), RIDGE * max(n, 1))
    penalty[-1] = 1e-6
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y at increasing x by pool-adjacent-violators: the mean place
    and the value of each pool."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


@dataclass
class Model:
    fourier: Fourier
    weights: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def column(self) -> Column:
        """A column function: statistics to the calibrated score."""

        @F.arrow_udf("double")
        def of(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in rows:
                yield pa.array(np.interp(self.fourier(_matrix(batch)) @ self.weights, self.places, self.values) if len(batch) else np.zeros(0))

        return of


def fit(rows: DataFrame) -> Model | None:
    """``rows``: (fold int, label double, statistics). None without both labels."""
    means = [F.avg(F.col("statistics")[i]) for i in range(N_STATISTICS)]
    spread = [F.stddev_pop(F.col("statistics")[i]) for i in range(N_STATISTICS)]
    found = rows.agg(F.count("*"), F.min("label"), F.max("label"), *means, *spread).first()
    if not found[0] or found[1] == found[2]:
        return None
    deviation = np.array(found[3 + N_STATISTICS :], float)
    fourier = Fourier(np.array(found[3 : 3 + N_STATISTICS], float), np.where(deviation > 1e-9, deviation, 1.0))
    sums = rows.coalesce(PARTS).mapInArrow(_partial_sums(fourier), "fold long, n long, a binary, b binary").collect()
    size = FEATURES + 1
    a, b, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS, np.int64)
    for s in sums:
        a[s.fold] += np.frombuffer(s.a).reshape(size, size)
        b[s.fold] += np.frombuffer(s.b)
        n[s.fold] += s.n
    without = np.stack([solve(a.sum(0) - a[f], b.sum(0) - b[f], int(n.sum() - n[f])) for f in range(FOLDS)])
    lows, highs = -0.5, 1.5

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = fourier(_matrix(batch.column(2))), np.asarray(batch.column(0))
            score = np.einsum("ij,ij->i", x, without[fold])
            bins = ((np.clip(score, lows, highs) - lows) / (highs - lows) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(score), batch.column(1)], names=["bin", "score", "label"])

    bins = rows.mapInArrow(scored, "bin long, score double, label double").groupBy("bin").agg(F.avg("score").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    places, values = isotonic(np.array([r.x for r in bins]), np.array([r.y for r in bins]), np.array([float(r.w) for r in bins]))
    return Model(fourier, solve(a.sum(0), b.sum(0), int(n.sum())), places, values)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: (id, held_out, score, predicted).

    Labels are learnt from rows that aren't held out; of repeated labels the mean counts,
    null labels and ids don't. A null text is empty; it is scored like others. A null id
    isn't held out. Without both labels every score is 0.5. An empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), statistics_column()(F.coalesce(F.col(text_col), F.lit(""))).alias("statistics"))
    rows = scratch.keep(rows, "statistics")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null and not isnan(label)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.avg("label").alias("label"))
    share = min(1.0, MAX_FIT / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    training = scratch.keep(rows.join(known, "doc_id").select(fold.alias("fold"), "label", "statistics"), "training")
    model = fit(training)
    value = F.lit(0.5) if model is None else model.column()("statistics")
    out = rows.select(F.col("doc_id").alias(id_col), held_out("doc_id").alias("held_out"), value.alias("score"))
    return out.select("*", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
