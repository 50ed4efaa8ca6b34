import hashlib
import random
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import registry, runs


def brute(words, least=6, times=4):
    """By the definition: for each period the maximal stretches, without those of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k > i and k - i + q >= max(least, times * q):
                if not any(s <= i and i + (k - i + q) <= s + m and p < q for s, m, p in found):
                    found.append((i, k - i + q, q))
            i = max(k, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=60))
def test_runs_of_few_words(words):
    assert runs.text_runs(words) == brute(words)
    assert runs.text_runs(words, 2, 2) == brute(words, 2, 2)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=6), st.integers(1, 12)), max_size=8))
def test_runs_of_repeated_blocks(blocks):
    words = list("".join(b * k for b, k in blocks))
    assert runs.text_runs(words) == brute(words)


def test_hashes_that_collide_are_found_out(monkeypatch):
    monkeypatch.setattr(runs.Extensions, "_same", lambda self, i, j, n: True)
    words = list("abcabcabcabcabcabd" * 3 + "aaaaaaaaaaaabbbbbbbbb")
    assert runs.text_runs(words) == brute(words)


@pytest.mark.parametrize("kind", ["one", "long", "fibonacci", "random"])
def test_long_texts_take_seconds(kind):
    n = 200_000
    rng = random.Random(3)
    fib = ["a", "ab"]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    words = {"one": ["x"] * n, "long": [str(i % 40_000) for i in range(n)], "fibonacci": list(fib[-1][:n]), "random": [rng.choice("ab") for _ in range(n)]}[kind]
    began = time.perf_counter()
    found = runs.text_runs(words)
    assert time.perf_counter() - began < 30
    assert {"one": [(0, n, 1)], "long": [(0, n, 40_000)], "fibonacci": []}.get(kind, found) == found
    assert all(words[s : s + m - q] == words[s + q : s + m] for s, m, q in found)


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark):
    found = registry.op12_runs(spark, "/root/testdata/sf0.001").collect()
    wanted = [brute_row(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sorted(map(tuple, found)) == sorted(wanted) and any(r[1] for r in wanted)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b " * 9, "x"), (3, "a b " * 9, "x"), (None, "a", "x"), (4, " \x0bq\x1cq\tq q q\x1cq q q\n" + "q " * 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = runs.periodic_runs(docs).collect()
    assert [([tuple(x) for x in r.runs], r.collapsed) for r in found] == [([], ""), ([], ""), ([(0, 18, 2)], "a b"), ([(0, 18, 2)], "a b"), ([], "a"), ([(4, 10, 1)], "q\x1cq q q q\x1cq q")]
    assert runs.periodic_runs(docs.limit(0)).collect() == []
