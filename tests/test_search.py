"""Search against SQLite's full-text index and against planted texts."""

import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import bands as L
from tidemark.functions import text as T
from tidemark.functions.stems import stem
from tidemark.operators import changes as C
from tidemark.operators import rewrite as W
from tidemark.operators import search as S
from tidemark.operators.ann import VectorIndex
from tidemark.sources.store import Postings

NOW = 1735689600.0
WORDS = "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky invoices billing payments running cooking ingredients screenshots errors traceback a be is 2026 x1y2 apology analogy yes day".split()


def fts(rows, columns=("text",)):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5({', '.join(columns)}, tokenize='porter unicode61')")
    con.executemany(f"insert into t(rowid, {', '.join(columns)}) values ({', '.join('?' * (len(columns) + 1))})", rows)
    return con


def test_stems_against_sqlite():
    con = fts([(i, w) for i, w in enumerate(WORDS)])
    con.execute("create virtual table v using fts5vocab('t', 'instance')")
    wanted = {i: term for term, i in con.execute("select term, doc from v")}
    assert {i: stem(w) for i, w in enumerate(WORDS)} == wanted


def quoted(query):
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in query.split())


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_stems_diacritics_and_scores_against_sqlite(spark, seed):
    rng = random.Random(seed)
    pool = [*WORDS[:40], "don't", "well_known", "café", "CAFÉ", "Ünïcode", "naïve", "the", "the", "of", "tip-top"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))) for i in range(60)]
    queries = [(1, "don't stop"), (2, "cafe the hopefully"), (3, "well_known naive"), (4, 'pen" OR ('), (5, "the the"), (6, "tip-top don-t"), (7, "!!! --"), (8, "unicode relate")]
    found = S.bm25(spark.createDataFrame(rows, "file_id long, text string"), ["file_id"], "text", spark.createDataFrame(queries, "query_id int, query string"), stems=True)
    got = {(r.query_id, r.file_id): r.score for r in found.collect()}
    con, wanted = fts(rows), {}
    for i, q in queries:
        if any(c.isalnum() for c in q):
            wanted |= {(i, row): -rank for row, rank in con.execute("select rowid, rank from t where t match ?", (quoted(q),))}
    assert got.keys() == wanted.keys()
    for key, value in wanted.items():
        assert got[key] == pytest.approx(value, abs=1e-5), key


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rewriting(spark):
    today = F.lit("2026-03-15").cast("date")
    rows = [(1, "invoice from last month"), (2, "error screenshots march"), (3, "pen with blue book"), (4, "bills from March"), (5, "!!"), (6, "maybe")]
    found = {r.id: r for r in W.rewritten(spark.createDataFrame(rows, "id int, query string"), today).collect()}
    assert found[1].terms == ["bill", "billing", "from", "invoice", "last", "month", "payment", "receipt"] and found[1].kinds == ["doc"]
    assert (found[1].date_from, found[1].date_to) == (1769904000.0, 1772323200.0)
    assert found[2].kinds == ["image"] and "traceback" in found[2].terms and found[2].date_from == 1772323200.0
    assert found[3].kinds == ["image"] and {"pencil", "notebook", "diary"} <= set(found[3].terms) and found[3].date_from is None
    assert found[4].kinds == [] and found[4].date_to == 1775001600.0 and found[5].terms == ["!!"] and found[6].date_from == 1777593600.0
    assert all(r.backend == "regex" for r in found.values())


@pytest.mark.parametrize(
    ("answer", "terms", "kind"),
    [
        ("bill, Receipt!, payment | doc", ["bill", "receipt", "payment"], "doc"),
        ("<think>\nwhat is it\n</think>\n\nscan, copy\nmore", ["scan", "copy"], None),
        ("<think> still at it, bill", None, None),
        ("| doc | bill", ["bill"], "doc"),
        ("invoice | last month | image", [], "image"),
        ("1st, x, " + "a" * 25 + ", last invoice", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_answers_of_a_model(spark, answer, terms, kind):
    known = F.array(*map(F.lit, ["invoice", "last", "month"]))
    found = one(spark, W.answered(F.lit(answer).cast("string"), known))
    assert (None, None) == (terms, kind) if found is None else (found.terms, found.kind) == (terms, kind)


def test_an_answer_only_adds(spark):
    rows = spark.createDataFrame([("invoice", "statement | image")], "query string, told string")
    r = W.rewritten(rows, F.lit("2026-01-01").cast("date"), F.col("told")).first()
    assert "statement" in r.terms and "invoice" in r.terms and r.kinds == ["doc", "image"] and r.backend == "model"


def test_names_and_metadata(spark):
    cases = {
        "kali-linux-2026.2-installer-amd64.iso": ["kali-linux-2026.2-installer-amd64.iso kali linux 2026.2 installer amd64 iso", "Kali Linux 2026.2 Installer amd64 ISO disk image"],
        "backup.tar.gz": ["backup.tar.gz backup tar gz", "Backup Tar GZ archive. Contents: main.py READ ME"],
    }
    entries = F.array(F.lit("src/main.py"), F.lit("READ_ME"))
    for name, wanted in cases.items():
        assert one(spark, T.metadata_chunks(F.lit(f"/d/{name}"), entries)) == wanted
    kinds = {"a.msix": "executable", "a.parquet": "data", "a.TAR.GZ": "archive", "notes.txt": None, "photo.jpg": None, "a.m4a": "media", "a.vhdx": "disk-image"}
    assert {k: one(spark, T.binary_kind(F.lit(k))) for k in kinds} == kinds
    assert one(spark, F.array(*[T.should_process(F.lit(x)) for x in ("a.txt", "~$a.docx", "a.pptx", "a.xlsx", "a.zip", "a.part", ".part1.txt")])) == [True, False, False, False, True, False, False]


def test_marked_text(spark):
    mark = lambda text, terms: one(spark, T.marked(F.lit(text), F.array(*map(F.lit, terms))))
    assert mark("The Café is open.", ["cafe"]) == "The <mark>Café</mark> is open."
    assert mark("nothing here", ["cafe"]) == "" and mark("", ["a"]) == ""
    far = " ".join(f"w{i}" for i in range(40)) + " blue pen, " + " ".join(f"v{i}" for i in range(40))
    shown = mark(far, ["blue", "pen"])
    assert shown.startswith("…") and shown.endswith("…") and "<mark>blue</mark> <mark>pen</mark>," in shown
    parts = one(spark, T.mark_parts(F.lit("a <mark>b</mark> c")))
    assert [(p.text, p.hit) for p in parts] == [("a ", False), ("b", True), (" c", False)]


PLANTED = {
    "pen_note.txt": "pen with blue book on the desk, morning study notes",
    "invoice_march.txt": "invoice for web design work, dated 12 March, total 900 dollars",
    "error_shot.txt": "screenshot of the error: TypeError cannot read property id of undefined, full traceback below",
    "recipe.txt": "flour, sugar and butter for the cake, bake for an hour",
    "resume.txt": "curriculum of an engineer, ten years of work",
    "meeting.txt": "agenda of the meeting on monday",
    "travel.txt": "train to the sea, two nights",
    "garden.txt": "tomatoes and beans in the garden",
}


def planted(spark):
    files = spark.createDataFrame([(i, f"/d/{n}", "text", NOW - 40 * 86400.0, "") for i, n in enumerate(PLANTED)] + [(90, "/d/scan.png", "image", NOW, "Pens and Café sign")], "file_id long, path string, kind string, mtime double, ocr_text string")
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(PLANTED.values())], "file_id long, ordinal int, text string")
    vectors = spark.createDataFrame([(i, 0, "text", [float(i == k) for k in range(8)]) for i in range(8)], "file_id long, ordinal int, space string, vec array<double>")
    return files, chunks, vectors


def test_planted_texts_are_found_first(spark):
    asked = {1: ("pen with blue book", "pen_note.txt"), 2: ("invoices from March", "invoice_march.txt"), 3: ("screenshots of that error", "error_shot.txt")}
    queries = spark.createDataFrame([(i, q, [0.0] * 7 + [1.0]) for i, (q, _) in asked.items()] + [(4, "  ", [1.0] + [0.0] * 7)], "query_id int, query string, query_vec array<double>")
    found = S.search(queries, *planted(spark), NOW).collect()
    assert {r.query_id for r in found} == {1, 2, 3}
    for i, (_, name) in asked.items():
        top = sorted((r for r in found if r.query_id == i), key=lambda r: r.rank)[:3]
        hit = next(r for r in top if r.path.endswith(name))
        assert "<mark>" in hit.snippet and hit.snippet_source == "chunk" and hit.match_keyword > 0.9 and hit.matched_via in ("keyword", "both")
    pen = next(r for r in found if r.query_id == 1 and r.file_id == 90)
    assert pen.snippet == "<mark>Pens</mark> and Café sign" or pen.snippet_source == "ocr"
    far = next(r for r in found if r.query_id == 1 and r.matched_via == "semantic")
    assert far.snippet and far.snippet_source == "chunk" and "<mark>" not in far.snippet


def test_search_over_kept_words_and_an_index_of_vectors(spark, tmp_path):
    files, chunks, vectors = planted(spark)
    queries = spark.createDataFrame([(1, "pen with blue book", [0.0] * 7 + [1.0]), (2, "invoices from March", [1.0] + [0.0] * 7)], "query_id int, query string, query_vec array<double>")
    whole = sorted(map(tuple, S.search(queries, files, chunks, vectors, NOW).collect()))
    kept = Postings(spark, f"{tmp_path}/c", stems=True), Postings(spark, f"{tmp_path}/n", stems=True)
    kept[0].update(chunks)
    kept[1].update(S.named(files))
    near = VectorIndex.build(spark, f"{tmp_path}/v", vectors.where("space = 'text'"), probes=8)
    unread = chunks.withColumn("text", F.when(F.rand() < 2, F.col("text")))
    got = S.search(queries, files, unread, vectors, NOW, kept=kept, near=near, latency=f"{tmp_path}/latency")
    assert sorted(map(tuple, got.collect())) == whole and spark.read.parquet(f"{tmp_path}/latency").count() == 1
    # a retriever that fails takes nothing from the others, and leaves its row as well
    broken = vectors.withColumn("vec", F.when(F.col("ordinal") == 0, F.raise_error(F.lit("no model")).cast("array<double>")).otherwise(F.col("vec")))
    left = S.search(queries, files, chunks, broken, NOW, kept=kept, latency=f"{tmp_path}/latency").collect()
    assert {r.matched_via for r in left} == {"keyword"} and {r.query_id for r in left} == {1, 2}
    assert spark.read.parquet(f"{tmp_path}/latency").count() == 2


def test_a_failing_retriever_gives_nothing_and_latency_is_kept(spark, tmp_path):
    schema = "query_id int, file_id long, rank int"
    broken = S.or_nothing(lambda: spark.range(1).select(F.raise_error(F.lit("no model")).alias("query_id"), F.col("id").alias("file_id"), F.lit(1).alias("rank")), schema, spark)
    whole = S.or_nothing(lambda: spark.createDataFrame([(1, 5, 1)], schema), schema, spark)
    assert broken.count() == 0 and S.fuse(keyword=whole, dense=broken).first().matched_via == "keyword"
    assert S.timed(lambda: 7, spark, f"{tmp_path}/latency") == 7
    with pytest.raises(ValueError):
        S.timed(lambda: int("x"), spark, f"{tmp_path}/latency", "model")
    assert sorted(r.backend for r in spark.read.parquet(f"{tmp_path}/latency").collect()) == ["model", "search"]


def test_more_queries_than_one_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, 0, [float(x) for x in rng.normal(size=4)]) for i in range(20)], "file_id long, ordinal int, vec array<double>")
    queries = vectors.select(F.col("file_id").alias("query_id"), F.col("vec").alias("query_vec"))
    whole = sorted(map(tuple, S.cosine(vectors, queries).collect()))
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 3)
    assert sorted(map(tuple, S.cosine(vectors, queries).collect())) == whole


def test_line_bands():
    page = np.full((720, 1600), 255, np.uint8)
    for k in range(6):
        page[60 + 110 * k : 100 + 110 * k, 50:1550] = 0
    assert L.line_bands(page) == [(60 + 110 * k, 100 + 110 * k) for k in range(6)] and len(L.pieces(page)) == 12 and not L.dark(page)
    strip = np.full((140, 900), 255, np.uint8)
    strip[50:90, 100:700] = 0
    assert len(L.pieces(strip)) == 1
    night = np.full((120, 400), 20, np.uint8)
    night[40:80, 40:300] = 240
    assert len(L.pieces(night)) == 1 and L.dark(night)
    speck = np.full((200, 600), 255, np.uint8)
    speck[90:94, 300:304] = 0
    assert L.pieces(speck) == [(0, 0, 600, 200)]
    many = np.full((3000, 100), 255, np.uint8)
    for k in range(60):
        many[50 * k + 10 : 50 * k + 30, 10:90] = 0
    found = L.line_bands(many)
    assert len(found) == 24 and found[0][0] == 10 and found[-1][1] == 50 * 59 + 30 and all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_purge_compact_usage_and_wipe(spark, tmp_path):
    files = spark.createDataFrame([(1, "/a"), (2, "/b")], "file_id long, path string")
    parts = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "file_id long, text string")
    names = files.select(F.concat(F.sha1("path"), F.lit(".jpg")).alias("name"))
    left = C.purge(files.where("path = '/b'"), files, parts, parts, names)
    assert {k: v.count() for k, v in left.items()} == {"files": 1, "chunks": 1, "vectors": 1, "thumbnails": 1}
    folder = f"{tmp_path}/t"
    for k in range(3):
        C.append_record(spark, folder, k=k, note="n")
    C.compact(spark, folder, 1, ["k"])
    assert sorted(r.k for r in spark.read.parquet(folder).collect()) == [0, 1, 2] and spark.read.parquet(folder).rdd.getNumPartitions() == 1
    (tmp_path / "t").rename(tmp_path / "t.old")  # a compaction that was lost between its two renames
    C.compact(spark, folder, 2, ["k"])
    assert sorted(r.k for r in spark.read.parquet(folder).collect()) == [0, 1, 2] and not (tmp_path / "t.old").exists()
    sizes = {r.name: r.bytes for r in C.usage(spark, t=folder, none=f"{tmp_path}/no").collect()}
    assert sizes["t"] > 0 and sizes["none"] == 0 and sizes["total"] == sizes["t"]
    assert C.wipe(spark, folder, f"{tmp_path}/no") == 1


def test_keyword_search_reads_each_text_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b a c"), (2, "b"), (3, ""), (4, None), (5, "a-b a b")], "file_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "a-b c"), (3, "zz")], "query_id int, query string")
    found = S.bm25(rows, ["file_id"], "text", asked)
    assert "text#" not in found._jdf.queryExecution().analyzed().toString()
    one = sorted((r.query_id, r.file_id, round(r.score, 9)) for r in found.collect())
    monkeypatch.setattr(S, "SOUGHT", 0)
    assert one == sorted((r.query_id, r.file_id, round(r.score, 9)) for r in S.bm25(rows, ["file_id"], "text", asked).collect()) and len(one) == 4
