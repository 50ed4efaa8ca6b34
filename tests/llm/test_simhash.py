import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.scratch import Scratch


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in root:
        for q in root:
            if p < q and (p ^ q).bit_count() <= radius:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in root}


def expected(rows, radius=2):
    prints = [(i, brute_print(t)) for i, t in rows]
    roots = brute_components({p for _, p in prints}, radius)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return sorted(((i, p, least.get(roots[p])) for i, p in prints), key=str)


def got(spark, rows, schema="doc_id long, text string"):
    found = simhash.near_duplicates(spark.createDataFrame(rows, schema), Scratch(spark, "t")).collect()
    return sorted(((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found), key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 4)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t ", "  "]).join(copy)))
            n += 1
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n\x0b"), (903, "one"), (904, "ONE"), (905, "a b c")]
    assert got(spark, rows) == expected(rows)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s"), (7, "q r s t u v"), (7, "other words here")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices_equal_popcounts(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    lanes = np.concatenate([base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i, j in rng.integers(0, 64, (40, 2))])
    queries = lanes[::3] ^ np.uint64(2)
    wanted = {(i, j) for i, a in enumerate(queries) for j, b in enumerate(lanes) if int(a ^ b).bit_count() <= radius}
    assert set(zip(*map(list, simhash.within(queries, lanes, radius, False)), strict=True)) == wanted
    own = {(i, j) for i, a in enumerate(lanes) for j, b in enumerate(lanes) if j < i and int(a ^ b).bit_count() <= radius}
    assert set(zip(*map(list, simhash.within(lanes, lanes, radius, True)), strict=True)) == own


def test_large_buckets_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(1)
    prints = {0x1234567890ABCDEF}
    while len(prints) < 120:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(40)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    roots = simhash.link(spark.createDataFrame(rows, "fp long"), Scratch(spark, "t"), 2)
    linked = {r.node % (1 << 64): r.root % (1 << 64) for r in roots.collect()}
    wanted = brute_components(prints, 2)
    groups = lambda m: {frozenset(p for p in prints if m.get(p, p) == r) for r in {m.get(p, p) for p in prints}}
    assert groups(linked) == groups(wanted)


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (5, "zz yy xx ww", None), (None, "a b c d", "n"), (9, None, "e"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "a b c d", "y"), (5, "zz yy xx ww", None), (8, "", "e")], key=str)


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near(rng, n, length=300, share=0.015):
    """n texts of ``length`` words, each followed by a copy with words replaced, and their similarity."""
    for _ in range(n):
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(length)]
        copy = [f"x{rng.randrange(500)}" if rng.random() < share else w for w in words]
        a, b = " ".join(words), " ".join(copy)
        yield a, b, len(five(a) & five(b)) / len(five(a) | five(b))


def test_wide_counters_equal_popcounts():
    rng = np.random.default_rng(4)
    lanes = rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (150, 30), dtype=np.uint64)).astype(np.uint64)[:, :30].cumsum(axis=1, dtype=np.uint64)[:, -1]
    for radius in (4, 7, 20):
        wanted = {(i, j) for i, a in enumerate(lanes) for j, b in enumerate(lanes) if j < i and int(a ^ b).bit_count() <= radius}
        assert set(zip(*map(list, simhash.within(lanes, lanes, radius, True)), strict=True)) == wanted


def test_the_pipeline_drops_near_copies_by_similarity(spark):
    import corpus_pipeline

    found = list(near(random.Random(4), 150))
    rows = [(2 * i + k, t, "en", "h", len(t)) for i, (a, b, _) in enumerate(found) for k, t in enumerate((a, b))]
    rows += [(1000, None, "en", "h", 0), (1001, "", "en", "h", 0), (1002, "A short one", "en", "h", 0), (1003, "a short  ONE", "en", "h", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()}
    alike = {i for i, (_, _, s) in enumerate(found) if s >= 0.8}
    assert 30 < len(alike) < 150
    gone = {i for i in range(150) if 2 * i + 1 not in kept}
    assert gone <= alike and len(gone) >= 0.97 * len(alike)
    assert {2 * i for i in range(150)} <= kept and kept & {1000, 1001, 1002, 1003} == {1000, 1002}


def test_pairs_of_small_and_large_groups():
    rng = np.random.default_rng(5)
    g = np.sort(np.concatenate([rng.integers(0, 30, 200), np.full(90, 31)]))
    v = np.bitwise_and.reduce(rng.integers(0, 1 << 63, (3, len(g)), dtype=np.uint64), axis=0)
    wanted = {(i, j) for j in range(len(g)) for i in range(j) if g[i] == g[j] and int(v[i] ^ v[j]).bit_count() <= simhash.NEAR_RADIUS}
    a, b = simhash._in_groups(g, v)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == wanted and len(a) == len(wanted) > 100


def test_only_pairs_near_in_the_whole_sketch_are_candidates():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = rng.integers(0, 64, (60, 4, 6), dtype=np.uint64)
    words = base ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=2)  # near in all four words
    words[30:, 1:] = rng.integers(0, 1 << 63, (30, 3), dtype=np.uint64)  # near in the first only
    node = np.arange(60)
    columns = [np.full(60, 9), np.zeros(60, int), words[:, 0], node, node, words[:, 1], words[:, 2], words[:, 3]]
    batch = pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in columns], names=list("gsvnrabc"))
    found = {(r["a"], r["b"]) for out in simhash._near(True)(iter([batch])) for r in out.to_pylist()}
    apart = lambda i, j, k: sum(int(x).bit_count() for x in (words[i] ^ words[j])[:k])
    near = {(i, j) for j in range(60) for i in range(j) if apart(i, j, 1) <= simhash.NEAR_RADIUS}
    assert found == {(i, j) for i, j in near if apart(i, j, 4) <= simhash.WIDE_RADIUS}
    assert len(near) > 1500 and 400 < len(found) < 500


def test_similarity_of_two_columns_of_texts():
    found = [(a, b) for a, b, _ in near(random.Random(8), 30)] + [("a b", "A  b"), ("a b c d e f g h", "a b c d e f g h i"), ("a", "b"), ("x " * 50, "x x x x x")]
    found += [(found[0][0], b) for _, b in found]
    left, right = (pa.array(side) for side in zip(*found, strict=True))
    wanted = [len(five(a) & five(b)) >= 0.8 * len(five(a) | five(b)) for a, b in found]
    assert simhash.alike(left, right, 5, 0.8).tolist() == wanted and 5 < sum(wanted) < len(wanted)
