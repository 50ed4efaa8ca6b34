"""Each stage of the pipeline against a brute-force form of it, on its own input."""

import functools
import os
import pathlib
import random
import re
import time

import pytest
from test_linededup import brute as brute_lines

import corpus_pipeline
from tidemark.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(17)
WORDS = {"en": "the and of with this that from only thing water there would about people".split(), "de": "der die und nicht sich einer über schön werden haben wieder zwischen immer".split()}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "s", "n", "el", "ig", "ant"]) for _ in range(n))


@functools.cache
def rows():
    texts = [prose(["en", "de"][i % 2], RNG.randint(20, 90)) + "\n" + prose(["en", "de"][i % 2], 15) for i in range(60)]
    near = texts[0].split(" ")
    near[10] = "changed"
    extra = [None, "", " \n\t", "12 34 56", " ".join(near), texts[2], texts[2], "z" * 150_000, texts[4].split("\n")[0] + "\n" + prose("en", 30)]
    out = [(i, t, ["en", "de"][i % 2], f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    return out + [(100 + i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(extra)] + [(7, texts[7], "de", "src1", len(texts[7])), (None, prose("en", 40), None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs):
    at = tmp_path_factory.mktemp("sf")
    item = rows()[20][1].split("\n")[0]
    spark.createDataFrame([(1, item), (2, "no document holds these very words at all today"), (3, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs.write.parquet(f"{at}/documents.parquet")
    return str(at)


def kept(stage, spark, docs, sf_dir):
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs.selectExpr("*", "1 as row", "2 as hash", "3 as __id", "4 as id"), sf_dir)
    assert found.columns == corpus_pipeline.COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def test_language_id_rejects_texts_without_letters_only(spark, docs, sf_dir):
    wanted = [r for r in rows() if r[1] and any(c.isalpha() for c in r[1])]
    assert kept("language_id", spark, docs, sf_dir) == sorted(wanted, key=str)


def test_line_dedup(spark, docs, sf_dir):
    own = rows()
    found = kept("line_dedup", spark, docs, sf_dir)
    brute = brute_lines([(r[0], r[1]) for r in own])
    assert [(r[0], r[1]) for r in found] == [(i, t) for i, t, n, gone in brute if gone == 0 or gone < n]
    before = {(r[0], r[1]): r for r in own}
    for r in found:
        assert r[4] == (before[r[0], r[1]][4] if (r[0], r[1]) in before else len(r[1]))


def five(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def test_simhash_dedup(spark, docs, sf_dir):
    own = rows()
    sets, root = [five(r[1]) for r in own], list(range(len(own)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(own)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(own):
        groups.setdefault(find(i), []).append(r)
    wanted = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    found = kept("simhash_dedup", spark, docs, sf_dir)
    assert [r[0] for r in found] == [r[0] for r in sorted(wanted, key=str)] and set(found) <= set(own)


def test_decontamination(spark, docs, sf_dir):
    item = rows()[20][1].split("\n")[0]
    wanted = [r for r in rows() if item not in (r[1] or "")]
    assert kept("decontamination", spark, docs, sf_dir) == sorted(wanted, key=str)


def test_best_fit_packing_and_round_trip(spark, docs, sf_dir):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    found = corpus_pipeline.best_fit_packing(spark, docs, sf_dir).collect()
    lengths = sorted(len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    assert sum(r.length for r in found) == sum(lengths)
    assert sorted(r.length for r in found if r.piece == 0) == sorted(min(n, 2048) for n in lengths)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(lengths) // 2048) + 2


def test_empty_tables_and_the_whole_run(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    found = corpus_pipeline.run(spark, sf_dir)
    ids = {r.doc_id for r in found.collect()}
    assert 20 not in ids and 100 not in ids and 0 in ids and 104 not in ids


@pytest.mark.parametrize("stage", ["simhash_dedup", "decontamination", "best_fit_packing"])
def test_executors_give_heap_back_before_python_workers_fill_up(spark, docs, sf_dir, stage, monkeypatch):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    own, before = docs.limit(0), full()
    monkeypatch.setattr(corpus_pipeline.Scratch, "release", lambda self: None)  # the driver's own
    dict(corpus_pipeline.STAGES)[stage](spark, own, sf_dir)
    assert full() > before


def test_driver_gives_back_heap(spark):
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    filled = [jvm.java.nio.ByteBuffer.allocate(64 << 20) for _ in range(12)]
    assert heap.totalMemory() > 700 << 20
    del filled
    time.sleep(1)  # the JVM's references go in the background
    corpus_pipeline.Scratch(spark, "t").release()
    assert heap.totalMemory() < 1.9 * (heap.totalMemory() - heap.freeMemory())


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps"), reason="native memory can't be read here")
def test_driver_gives_back_native_memory(spark):
    jvm, scratch = spark.sparkContext._jvm, corpus_pipeline.Scratch(spark, "t")

    def taken():  # MB, without the heap, which is below 2^36
        maps = pathlib.Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps").read_text()
        found = re.findall(r"^([0-9a-f]+)-[0-9a-f]+ .*?^Anonymous:\s+(\d+)", maps, re.M | re.S)
        return sum(int(kb) for start, kb in found if int(start, 16) >> 36) / 1024

    scratch.release()
    before = taken()
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(4000)]
    assert taken() > before + 300
    buffers = buffers[::16]  # the C library keeps what lies between
    time.sleep(1)
    scratch.release()
    time.sleep(1)  # buffers are freed behind the first collection
    scratch.release()
    assert len(buffers) == 250 and taken() < before + 150


def test_tables_are_kept_while_the_heap_stays_small(spark, monkeypatch):
    heap, calls = spark.sparkContext._jvm.java.lang.Runtime.getRuntime(), []
    scratch = corpus_pipeline.Scratch(spark, "t")
    scratch.release()
    monkeypatch.setattr(corpus_pipeline.Scratch, "release", lambda self: calls.append(1))
    assert 2 * heap.totalMemory() < heap.maxMemory()
    assert scratch.keep(spark.range(3), "small").count() == 3 and not calls
    full = spark.sparkContext._jvm.java.nio.ByteBuffer.allocate(heap.maxMemory() * 6 // 10)
    assert scratch.keep(spark.range(3), "large").count() == 3 and calls and full.capacity()
    scratch._settled = heap.maxMemory()  # a heap that doesn't shrink
    assert scratch.keep(spark.range(3), "again").count() == 3 and len(calls) == 1
