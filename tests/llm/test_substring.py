import random
import re
from collections import Counter

import pytest

from tidemark.llm import substring
from tidemark.llm.scratch import Scratch


def brute(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {k for s in range(len(w) - width + 1) if count[tuple(w[s : s + width])] > 1 for k in range(s, s + width)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, width, spread):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(spread)] + ["ü", "a b", "語"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(6)]
    rows = []
    for n in range(50):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3 * width))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            k = rng.randint(0, len(words))
            words[k:k] = p
        rows.append((n, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows + [(n + 100, t) for n, t in rows[:3]]


def run(spark, rows, width, **kw):
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), width, **kw)
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize(("width", "spread", "seed"), [(35, 400, 1), (12, 4, 2), (5, 3, 3)])
def test_against_brute_force(spark, width, spread, seed):
    rows = corpus(seed, width, spread)
    assert run(spark, rows, width) == brute(rows, width)


def test_nulls_repeats_and_empty_table(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n "), (None, long), (5, long + " tail"), (6, "y " * 80), (7, "short"), (7, "short"), (8, "z " * 35), (8, "z " * 35)]
    assert run(spark, rows, 35) == brute(rows, 35)
    assert run(spark, [], 35) == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_later_batches_need_no_earlier_documents(spark):
    """Batch by batch into one index, past its fanout: each equals brute force on all so far."""
    rows = corpus(4, 12, 6)
    index = substring.FingerprintIndex(spark, Scratch(spark, "t").root + "/index", fanout=2, buckets=3)
    for end in (14, 27, 40, len(rows)):
        start = {14: 0, 27: 14, 40: 27}.get(end, 40)
        found = substring.without_repeats(frame(spark, rows[start:end]), Scratch(spark, "t"), 12, index=index)
        new = {r[0] for r in rows[start:end]}
        assert sorted(map(tuple, found.collect()), key=str) == [r for r in brute(rows[:end], 12) if r[0] in new]
    assert len(index.runs()) <= 2
    again = substring.FingerprintIndex(spark, index.path)  # as another session finds it
    found = substring.without_repeats(frame(spark, [(900, rows[5][1]), (901, "not held " * 3)]), Scratch(spark, "t"), 12, index=again)
    assert again.buckets == 3
    assert sorted(map(tuple, found.collect()), key=str) == [r for r in brute([*rows, (900, rows[5][1]), (901, "not held " * 3)], 12) if r[0] >= 900]


def test_runs_are_merged_bucket_by_bucket(spark, tmp_path):
    index = substring.FingerprintIndex(spark, f"{tmp_path}/index", buckets=4)
    kinds = lambda *v: spark.createDataFrame([(fp, fp + 1, 0, c, 1, 0, 0) for fp, c in v], substring.KINDS)
    first = index.add(kinds((5, 2), (-9, 1)))
    index.add(kinds((7, 1), (-9, 1)))
    look = index.table(first).join(index.table(index.runs()[1]), "fp", "left_semi").hint("merge")
    plan = look._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan, plan
    plan = substring._merged(index.table(first), index.table(index.runs()[1]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan, plan
    index.compact()
    assert len(index.runs()) == 1
    assert sorted((r.fp, r.c) for r in index.table(index.runs()[0]).collect()) == [(-9, 2), (5, 2), (7, 1)]
    index.compact()
    assert len(index.runs()) == 1


def test_one_passage_in_very_many_documents_and_a_very_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(1500)] + [(5000, " ".join(f"q{i % 50_000}" for i in range(100_000)))]
    found = run(spark, rows, 35)
    assert found == brute(rows, 35)


def test_executors_give_memory_back_between_the_steps(spark, monkeypatch):
    steps, keep, shrink = [], Scratch.keep, Scratch.shrink
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: steps.append(name) or keep(self, df, name))
    monkeypatch.setattr(Scratch, "shrink", lambda self: steps.append("shrink") or shrink(self))
    rows = corpus(5, 12, 6)
    assert run(spark, rows, 12) == brute(rows, 12)
    before = {s: steps[i - 1] if i else None for i, s in enumerate(steps)}
    assert [before[f"{s}{b}"] for b in (0, 1) for s in ("hits", "kinds", "windows")] == ["shrink"] * 6
    assert steps[-1] == "shrink"  # the result's Python workers come next
