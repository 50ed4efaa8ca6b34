import random
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm import quality
from tidemark.llm.scratch import Scratch


def test_statistics_are_finite_and_do_not_depend_on_neighbours():
    texts = ["", " ", "One two two.", "A!! B!!", "x" * 5000, "é | è | ü\n\n12", "w"]
    together = quality.statistics(pa.array(texts))
    assert together.shape == (7, quality.N_STATISTICS) and np.isfinite(together).all()
    for i, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t]))[0], together[i])


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(40.0), rng.normal(size=40) + np.arange(40) / 10, rng.integers(1, 5, 40).astype(float)
    places, values = quality.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
    # min-max formula of the monotone fit
    best = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(values, 9))


def test_fourier_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(30, quality.N_STATISTICS))
    f = quality.Fourier(np.zeros(quality.N_STATISTICS), np.ones(quality.N_STATISTICS))(rows)[:, :-1]
    gap = ((rows[:, None] - rows[None]) ** 2).sum(-1)
    assert np.abs(f @ f.T - np.exp(-gap / (4 * quality.N_STATISTICS))).mean() < 0.08


def make(n, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 8)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(20, 200))]
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_held_out_labels_are_not_learnt(spark):
    docs, labels = make(600)
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - q) for i, q in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    runs = []
    for known in (labels, flipped):
        found = quality.score(frame, spark.createDataFrame(known, "doc_id long, quality int"), Scratch(spark, "t")).collect()
        runs.append(sorted((r.doc_id, r.held_out, r.score, r.predicted) for r in found))
    assert runs[0] == runs[1]
    truth = dict(labels)
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 and p == int(s >= 0.5) for i, h, s, p in runs[0])
    held = [(i, p) for i, h, _, p in runs[0] if h]
    assert sum(truth[i] == p for i, p in held) >= 0.98 * len(held)


def test_nulls_repeats_and_empty(spark):
    docs, labels = make(60)
    frame = spark.createDataFrame(docs + [(None, "a b"), (900, None), (900, None), (901, "x" * 100_000)], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    found = quality.score(frame, known, Scratch(spark, "t")).collect()
    assert len(found) == 64 and all(0 <= r.score <= 1 for r in found)
    none = quality.score(frame, known.limit(0), Scratch(spark, "t")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score(frame.limit(0), known, Scratch(spark, "t")).count() == 0
