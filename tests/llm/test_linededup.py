import random
from collections import defaultdict

from tidemark.llm import linededup
from tidemark.llm.scratch import Scratch


def shingles(line):
    return {line[i : i + 8] for i in range(max(len(line) - 7, 1))}


def brute(rows):
    """Documents without the lines that go, with all pairs of distinct lines compared."""
    found = {(i, t): [(p, x) for p, x in enumerate(t.split("\n")) if x.strip(linededup.BLANK)] for i, t in rows if t is not None}
    lines = sorted({x for own in found.values() for _, x in own})
    sets, root = {x: shingles(x) for x in lines}, {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in lines:
        for b in lines:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    places = defaultdict(list)
    for (i, t), own in found.items():
        for p, x in own:
            places[find(x)].append((i is not None, i or 0, p, t))
    stays = {min(v, key=lambda q: q[:3])[1:] for v in places.values()}
    out = []
    for i, t in rows:
        own = found.get((i, t), [])
        gone = {p for p, _ in own if (i or 0, p, t) not in stays}
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone), len(own), len(gone)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "7 as n_lines", "'x' as lh")
    found = linededup.dedup_lines(docs, Scratch(spark, "t"))
    assert found.columns == ["doc_id", "text", "lh", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows = []
    for n in range(60):
        own = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice(base).split(" ") if rng.random() < 0.7 else [word() for _ in range(20)]
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = word()
            own.append(" ".join(words))
        rows.append((n, "\n".join(own)))
    got, wanted = run(spark, rows), brute(rows)
    same = sum(a == b for a, b in zip(got, wanted, strict=True))
    assert same >= 0.95 * len(rows)  # banding may miss a pair near the threshold
    assert sum(r[3] for r in got) >= 0.98 * sum(r[3] for r in wanted)


def test_chains_join_one_component(spark):
    words = [f"word{i:03d}" for i in range(80)]
    chain = []
    for k in range(6):
        words = list(words)
        words[10 * k] = f"edit{k:03d}"
        words[10 * k + 5] = f"also{k:03d}"
        chain.append(" ".join(words))
    rows = [(k, x) for k, x in enumerate(chain)]
    assert [r[3] for r in run(spark, rows)] == [0, 1, 1, 1, 1, 1]
    assert run(spark, rows) == brute(rows)


def test_nulls_ties_repeats_long_and_empty(spark):
    rows = [(1, None), (2, ""), (3, "\n \n\t\n\t \r"), (4, "same line here\n\nsame line here\nab"), (None, "same line here"), (5, "ab\nab"), (6, "z" * 200_000), (7, "z" * 199_990), (8, "a b"), (8, "a b")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_recall_of_the_bands():
    rng, hit = random.Random(3), 0
    for _ in range(4000):
        agree = [rng.random() < 0.8 for _ in range(linededup.MINS)]
        hit += any(all(agree[k] for k in band) for band in linededup.BANDS)
    assert hit / 4000 > 0.945


def test_a_centre_that_no_line_chose_is_compared(spark):
    """Hashes a < d < b, c: bucket x {a, b, c} has centre a, bucket y {b, c, d} centre d, which
    b and c both choose; a's near copies are found all the same."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(60)]
    lines = []
    for k in range(4):
        words = list(base)
        words[15 * k + 5] = word()
        lines.append(" ".join(words))
    assert all(len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y)) for x in lines for y in lines)
    hashes = {r.line: r.lh for r in spark.createDataFrame([(x,) for x in lines], "line string").selectExpr("line", "xxhash64(line) as lh").collect()}
    a, d, b, c = (hashes[x] for x in sorted(lines, key=hashes.get))
    # bands are the rows and columns of a square of minima: a, b, c share the first row, b, c, d the second
    rows = []
    for k, (x, own) in enumerate(((a, [1]), (b, [1, 2]), (c, [1, 2]), (d, [2]))):
        minima = [100 * k + j for j in range(linededup.MINS)]
        minima[12:16] = [6, 7, 8, 9]  # so that all agree in eight minima
        for row in own:
            minima[4 * (row - 1) : 4 * row] = [row] * 4
        rows.append((x, 1, *minima))
    sketch = spark.createDataFrame(rows, "lh long, occurs long, " + ", ".join(f"m{k} int" for k in range(linededup.MINS)))
    roots = linededup.line_classes(spark.createDataFrame([(x,) for x in lines], "line string"), sketch, Scratch(spark, "t"))
    assert {(r.node, r.root) for r in roots.collect()} == {(x, a) for x in (b, c, d)}


def test_small_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(30)]
    rows = []
    for k in range(40):  # a bucket of many lines in several components
        words = list(base)
        for j in rng.sample(range(30), rng.randint(0, 3)):
            words[j] = word()
        rows.append((k, " ".join(words)))
    whole = run(spark, rows)
    monkeypatch.setattr(linededup, "BLOCK", 4)
    monkeypatch.setattr(linededup, "FEW", 3)
    assert run(spark, rows) == whole


def test_measured_recall_and_precision_near_the_threshold(spark):
    """Pairs of lines at an exact similarity of 0.8 to 0.9: nine in ten are found at least, and none below 0.8."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(3, 9)))
    rows, near, far = [], [], []
    while len(near) < 150:
        base = [word() for _ in range(40)]
        other = list(base)
        for j in rng.sample(range(40), rng.randint(1, 5)):
            other[j] = word()
        a, b = " ".join(base), " ".join(other)
        at = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if at < 0.9:
            (near if at >= 0.8 else far).append(len(rows) + 1)
            rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {r[0] for r in run(spark, rows) if r[3]}
    assert len(gone & set(near)) >= 0.9 * len(near) and not gone & set(far)


def test_clashing_names(spark):
    names = ["__gone", "__hash", "__id", "row", "lines", "gone", "hash", "id", "pos", "text_hash", "old"]
    docs = spark.createDataFrame([(1, "a line\nof text", *names), (2, "a line", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = linededup.dedup_lines(docs, Scratch(spark, "t"))
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text, r.gone, r.id, r.n_removed) for r in found.collect()) == [(1, "a line\nof text", "gone", "id", 0), (2, "", "gone", "id", 1)]


def test_bitmaps_exclude_long_lines_that_differ_and_no_pair_that_is_similar(spark):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    long = letters(6000)
    lines = [long, letters(2000) + long[2000:], letters(300) + long[300:], "ab" * 40 + "c", "ab" * 30 + "c", "ab" * 40 + "dc", letters(40) * 3]
    lines += [lines[-1] + "x", "short", "shorter"]
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    maps = linededup.bitmaps(spark.createDataFrame(list(enumerate(lines)), "lh long, line string"))
    both = linededup._side(maps, "a").join(linededup._side(maps, "b"), linededup.F.expr("a < b"))
    found = {(r.a, r.b) for r in both.where(linededup._may_be_similar()).select("a", "b").collect()}
    alike = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike <= found and (0, 1) not in found and (0, 2) in alike and len(alike) > 2


def test_exact_similarity_of_pairs_by_generated_code(spark):
    """Lines of less than one run of hashes, of several, with repeats and at the threshold; no lambda hashes shingles."""
    rng = random.Random(44)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopé") for _ in range(n))
    lines = ["a", "a ", "shorter", "shorter than", "z" * 200, "z" * 30, "z" * 30 + "y", "ab" * 40, "ab" * 40 + "c", "abc" * 40]
    for n in (15, 16, 23, 24, 40, 120, 700):
        base = letters(n)
        lines += [base, base + letters(n // 9), base[n // 12 :], base[: n // 2] + "Q" + base[n // 2 :], base * 2, base[: n // 2] + letters(n - n // 2)]
    whole = letters(7 + 100)  # 80 of its 100 shingles, and nothing else: a similarity of just 0.8
    lines += [whole, whole[: 7 + 80], whole[: 7 + 79], "\U0001f600" + whole[: 7 + 80]]
    sets = [{x.encode("utf-16-be")[2 * i : 2 * i + 16] for i in range(max(len(x.encode("utf-16-be")) // 2 - 7, 1))} for x in lines]
    alike = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    texts = spark.createDataFrame(list(enumerate(lines)), "lh long, line string")
    pairs = spark.createDataFrame([(a, b) for b in range(len(lines)) for a in range(b)], "a long, b long")
    found = linededup.similar(pairs, texts)
    assert {(r.a, r.b) for r in found.collect()} == alike
    n = len(lines)
    assert (n - 4, n - 3) in alike and (n - 4, n - 2) not in alike and (4, 5) in alike and len(alike) > 10
    for df in (found, linededup.bitmaps(texts)):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_a_bitmap_is_one_column(spark):
    """So that a pair that the conditions before rule out reads none of its words."""
    texts = spark.createDataFrame([(1, "one line of text"), (2, "")], "lh long, line string")
    maps = linededup.bitmaps(texts)
    assert maps.columns == ["lh", "n", "bits"]
    assert [(r.lh, r.n, len(r.bits)) for r in maps.orderBy("lh").collect()] == [(1, 9, linededup.MAP_WORDS), (2, 1, linededup.MAP_WORDS)]


def test_blank_lines_of_all_kinds(spark):
    rows = [(1, "x\n \t\r\x0b\x0c\n\n x"), (2, "\t \n y \t"), (3, " \u00a0\n\u00a0")]
    assert run(spark, rows) == brute(rows)
    assert [r[2] for r in run(spark, rows)] == [2, 1, 2]
