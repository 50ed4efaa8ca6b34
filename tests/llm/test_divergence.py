import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from tidemark.llm import divergence, registry
from tidemark.llm.divergence import Trie, divergence as audit
from tidemark.llm.scratch import Scratch


def brute(rows, least, top):
    """From the definition, with Python's numbers."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(count, own):
            return 1 + 1_000_000_000 * (count + 5) // (sum(own[t] for t in kept) + 5 * len(kept))

        p = {s: {t: share(counts[lang, s][t], counts[lang, s]) for t in kept} for s in sources}
        q = {t: share(whole[t], whole) for t in kept}
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, top)):
                found += [(lang, s, *x, k) for k, x in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most], 1)]
    return sorted(found)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as docs", "'x' as counts")


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(divergence, "LEAVES", 50)
    monkeypatch.setattr(divergence, "STAGED", 40)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "ROWS", 20)
    monkeypatch.setattr(divergence, "CELLS", 60)
    words = ["a", "A", "ab", "abc", "ABÄ", "ä", "é1é", "日本", "日", "🙂", "x-y", "don't", "zz_z", "\x7fq", "Z"] + [rng.choice("abc") + rng.choice("xyzé") * rng.randint(0, 3) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s", "t", "u", None, "", "Ü"]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40])))) for _ in range(400)]
    rows += [("en", "hot", "a a a ab abc")] * 200 + [("en", "none", None), ("en", "silent", "123 !?"), ("fr", "s", "rare"), ("fr", "t", ""), ("alone", "s", "a " * 50)]
    found = audit(table(spark, rows), Scratch(spark, "t"), least=9, top=5).collect()
    assert sorted(map(tuple, found)) == brute(rows, 9, 5)
    assert {("fr", "s", "pair", "t", 0, 1), ("fr", "t", "pair", "s", 0, 1)} <= set(map(tuple, found))
    assert audit(table(spark, rows).limit(0), Scratch(spark, "t")).collect() == []


def test_tries_merge_in_utf8_order(monkeypatch):
    rng = random.Random(5)
    docs = [(rng.choice("xy"), rng.choice("st"), " ".join("".join(rng.choice("abé日🙂") for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([0, 1, 20])))) for _ in range(500)]
    trie, counts = Trie(), Counter()
    for k in range(0, 500, 50):
        trie.read(*zip(*((lang, source) for lang, source, _ in docs[k : k + 50]), strict=True), pa.array([t for _, _, t in docs[k : k + 50]]))
        if k % 100:
            trie.settle()
    for lang, source, text in docs:
        counts.update((lang, t.encode(), source) for t in text.split())
    found = [r for b in trie.leaves() for r in b.to_pylist()]
    assert [(r["lang"], r["term"].encode()) for r in found] == sorted((r["lang"], r["term"].encode()) for r in found)
    assert {(r["lang"], r["term"].encode(), r["source"]): r["n"] for r in found} == counts and list(trie.leaves()) == []
    assert sum(r["docs"] for r in found) == sum(len(set(t.split())) for _, _, t in docs)


def test_counts_beyond_64_bits():
    counts = np.array([0, 7, 10**16, 3 * 10**17])
    assert list(divergence.shares(counts, int(counts.sum()), 4)) == [1 + 10**9 * (int(c) + 5) // (int(counts.sum()) + 20) for c in counts]


def test_query_equals_sql(spark):
    base = "/root/testdata/sf0.01"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{base}/documents.parquet'")
    wanted = duckdb.sql(registry.oracle_sql()["op13_divergence"]).fetchall()
    assert sorted(map(tuple, registry.op13_divergence(spark, base).collect())) == sorted(wanted)


def test_blocks_of_merged_leaves(monkeypatch):
    """Small steps and blocks, in this process: no term is split or lost, whatever the cuts."""
    monkeypatch.setattr(divergence, "ROWS", 7)
    monkeypatch.setattr(divergence, "CELLS", 9)
    monkeypatch.setattr(divergence, "BLOCK", 3)
    rng = random.Random(8)
    rows = sorted((rng.choice(["de", "en", "fr"]), rng.choice("stu"), f"w{rng.randrange(30):02}", rng.randint(1, 3), rng.randint(1, 9)) for _ in range(400))
    rows.sort(key=lambda r: (r[0], r[2]))
    docs, counts = Counter(), Counter()
    for lang, source, term, d, n in rows:
        docs[lang, term] += d
        counts[lang, term, source] += n
    batches = [divergence._batch(divergence.LEAF, *map(list, zip(*rows[i : i + 5], strict=True))) for i in range(0, len(rows), 5)]
    found = [b.to_pylist()[0] for b in divergence._merge(9)(iter(batches))]
    assert all(len(b["terms"]) <= 3 and b["terms"] == sorted(b["terms"]) for b in found)
    got = {(b["lang"], b["terms"][k], s): n for b in found for k, s, n in zip(b["at"], b["sources"], b["counts"], strict=True)}
    assert got == {k: n for k, n in counts.items() if docs[k[:2]] >= 9} and sum(len(b["at"]) for b in found) == len(got)
