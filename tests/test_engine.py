import io
import json
import os
import sqlite3
import zipfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import rewrite
from tidemark.operators import search as S
from tidemark.plans import catalog
from tidemark.sources import extract, settings, store
from tidemark.streaming import watch

DATA = "/root/testdata/sf0.001"
HEAVY = {"emb_hashing", "agg_bm25_stats"}


def norm(v):
    return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["sr_hybrid", "sr_keyword_topk", "dml_upsert_files", "agg_cards", "agg_latency_backend", "w_chunks", "sr_snippet"])
def test_queries_agree_with_their_sql(spark, name):
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    found = catalog.queries()[name](spark, DATA)
    rel = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in found.collect()) == want


def test_bm25_is_that_of_an_independent_full_text_index(spark):
    texts = ["the blue pen and the red pen", "a blue book", "invoice for web design, March", "pen", "nothing here at all", "books and pens"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts)))
    want = {r: -s for r, s in db.execute("select rowid, rank from t where t match 'pen OR blue OR \"march\"'")}
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    found = S.bm25(rows, ["file_id"], "text", spark.createDataFrame([(1, "pen blue march")], "query_id int, query string")).collect()
    assert {r.file_id: pytest.approx(r.score, rel=1e-9) for r in found} == want


def test_names_dates_and_sizes(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    assert row(T.name_tokens(F.lit("/x/kali-linux-2026.2-installer-amd64.iso")))[0] == ["kali", "linux", "2026.2", "installer", "amd64", "iso"]
    assert row(*[T.human_size(F.lit(n)) for n in (0, 1023, 1536, 5 << 30)])[:] == ("0 B", "1023 B", "1.5 KB", "5.0 GB")
    assert row(T.duration(F.lit(61)), T.duration(F.lit(3661)))[:] == ("1:01", "1:01:01")
    assert row(T.binary_kind(F.lit("a/backup.tar.gz")), T.binary_kind(F.lit("notes.txt")))[:] == ("archive", None)
    today = F.lit("2025-01-15").cast("date")
    assert row(rewrite.date_range(F.lit("invoice from last month"), today))[0][:] == (1733011200.0, 1735689600.0)
    assert row(rewrite.kinds(F.lit("open the picture")))[0] == ["image"]


def test_extractors(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    notebook = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "a\nb\nc\nd"}]}).encode()
    rows = [("/a.docx", docx.getvalue()), ("/n.ipynb", notebook), ("/t.txt", b"caf\xc3\xa9 \xff"), ("/b.docx", b"broken"), ("/z.zip", docx.getvalue()), ("/p.pdf", b"%PDF")]
    found = {r.path: (r.kind, r.text) for r in extract.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["/a.docx"] == ("docx", "Hello\na | b") and found["/n.ipynb"] == ("notebook", "# T\nx\na\nb\nc")
    assert found["/t.txt"][1] == "café �" and found["/b.docx"] == ("docx", "") and found["/z.zip"] == ("archive", "word/document.xml") and found["/p.pdf"] == ("pdf", "")


def test_sheets_are_those_that_the_workbook_relates(spark):
    book = io.BytesIO()
    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Budget" r:id="rId7"/><sheet name="Empty" r:id="rId8"/><sheet name="Old" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId7" Target="worksheets/sheet9.xml"/><Relationship Id="rId8" Target="worksheets/none.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>rent</t></si></sst>")
        z.writestr("xl/worksheets/sheet9.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>900</v></c><c r="AY1"><v>far</v></c></row><row><c r="A2"><v> </v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="inlineStr"><is><t>past</t></is></c></row></sheetData></worksheet>')
    assert extract.read_sheets(book.getvalue()) == "Sheet Budget: rent | 900\nSheet Old: past"


def test_notebooks_and_settings_are_read_in_the_jvm(spark):
    cells = [{"cell_type": "markdown", "source": "a\nb\nc\nd"}, {"cell_type": "code", "source": ["x\n", "y\n", "z\n", "w"]}, {"cell_type": "code"}, {"source": "ünï"}, {"cell_type": "markdown", "source": ["m" * 30]}]
    rows = [(1, json.dumps({"cells": cells}).encode()), (2, b"{"), (3, b"[]"), (4, None), (5, json.dumps({"cells": []}).encode()), (6, b'{"cells": [{"source": "\xff"}]}')]
    frame = spark.createDataFrame(rows, "k int, content binary")
    found = {r.k: r.t for r in frame.select("k", settings.notebook_text(F.col("content"), 40).alias("t")).collect()}
    assert found == {1: ("a\nb\nc\nd\nx\ny\nz\n\nünï\n" + "m" * 30)[:40], 2: "", 3: "", 4: "", 5: "", 6: "\ufffd"}
    plan = extract.extract(spark.createDataFrame([("/n.ipynb", rows[0][1])], "path string, content binary"))
    assert plan.first().text.startswith("a\nb")
    texts = [('{"dark": true, "port": 7, "rate": "x", "folders": ["a", "b"], "extra": 1}',), ("",), (None,), ('{"port": null}',)]
    made = spark.createDataFrame(texts, "t string").select(settings.settings(F.col("t"), dark=False, port=8, rate=0.5, folders=["d"]).alias("s")).collect()
    default = (False, 8, 0.5, ["d"])
    assert [tuple(r.s) for r in made] == [(True, 7, 0.5, ["a", "b"]), default, default, default]


EVENTS = "ts long, event_id long, kind string, path string"


def test_change_stream_keeps_files_chunks_vectors_and_words(spark, tmp_path):
    texts = {"/a": "alpha words", "/b": "beta words " * 150, "/c": "gamma"}
    held = {"sizes": {}, "paused": False}

    def contents(paths):
        rows = [(p, float(len(t)), len(t), t) for p, t in texts.items()]
        return paths.join(spark.createDataFrame(rows, "path string, mtime double, size_bytes long, text string"), "path")

    def vectors(chunks):
        return chunks.select("file_id", "ordinal", F.lit("text").alias("space"), F.array(F.length("text").cast("double")).alias("vec"))

    index = watch.Index(spark, f"{tmp_path}/index")

    def send(*rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        watch.watch(spark, stream, index, contents, f"{tmp_path}/state", lambda: held["paused"], vectors=vectors).awaitTermination()

    def found(word):
        hits = index.postings.bm25(spark.createDataFrame([(1, word)], "query_id int, query string"), ["file_id"])
        return {r.path for r in hits.join(index.files.read(), "file_id").select("path").collect()}

    send((1, 1, "changed", "/a"), (2, 2, "changed", "/b"), (3, 3, "changed", "/none"))
    assert {r.path for r in index.files.read().collect()} == {"/a", "/b"} and index.chunks.read().count() == 3 == index.vectors.read().count()
    assert found("words") == {"/a", "/b"} and found("beta-words") == {"/b"}
    texts["/b"] = "delta"
    send((4, 4, "deleted", "/a"), (5, 5, "changed", "/c"), (6, 6, "deleted", "/c"), (7, 7, "changed", "/c"), (8, 8, "changed", "/b"))
    assert {r.path for r in index.files.read().collect()} == {"/b", "/c"} and index.chunks.read().count() == 2 == index.vectors.read().count()
    assert found("words") == set() and found("delta") == {"/b"} and found("gamma") == {"/c"}
    before = sorted(map(tuple, index.files.read().collect()))
    again = lambda key: index.apply(spark.createDataFrame([(9, 9, "changed", "/b")], EVENTS), contents(spark.createDataFrame([("/b",)], "path string")), key, vectors)
    again("k")
    index.apply(spark.createDataFrame([(9, 9, "deleted", "/b")], EVENTS), contents(spark.createDataFrame([("/b",)], "path string")).limit(0), "k", vectors)
    assert sorted(map(tuple, index.files.read().collect())) == before  # a batch that is run again changes nothing
    held["paused"] = True
    send((10, 10, "deleted", "/b"))
    held["paused"] = False
    send((11, 11, "changed", "/c"))
    assert sorted(map(tuple, index.files.read().collect())) == before  # dropped while paused; an unchanged file is left alone
    for table in (index.files, index.chunks, index.vectors, index.postings):
        table.compact()
    assert sorted(map(tuple, index.files.read().collect())) == before and found("delta") == {"/b"} and len(index.files.updates()) == 1


def test_kept_words_are_repaired(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "file_id long, ordinal int, text string")
    index = store.Postings(spark, f"{tmp_path}/words", stems=True)
    index.update(rows((1, 0, "pens and ink"), (1, 1, "paper"), (2, 0, "books")))
    now = rows((1, 0, "pens and ink"), (1, 1, "paper"), (3, 0, "a pen"), (4, 0, "open book"))
    assert index.backfill(now) == 3 and index.backfill(now) == 0
    queries = spark.createDataFrame([(1, "pen"), (2, "book")], "query_id int, query string")
    got = {(r.query_id, r.file_id, r.ordinal): round(r.score, 9) for r in index.bm25(queries, ["file_id", "ordinal"]).collect()}
    fresh = S.bm25(now, ["file_id", "ordinal"], "text", queries, stems=True).collect()
    assert got == {(r.query_id, r.file_id, r.ordinal): round(r.score, 9) for r in fresh} and (2, 2, 0) not in got


def test_updates_by_stream_and_repair_keep_apart(spark, tmp_path):
    """A repair between batches, a new checkpoint, and compactions lose no update."""
    texts = {"/a": "alpha words", "/b": "beta words", "/c": "delta words", "/d": "epsilon"}

    def contents(paths):
        return paths.join(spark.createDataFrame([(p, 1.0, len(t), t) for p, t in texts.items()], "path string, mtime double, size_bytes long, text string"), "path")

    index = watch.Index(spark, f"{tmp_path}/index")

    def send(state, *rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{state}")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in-{state}")
        watch.watch(spark, stream, index, contents, f"{tmp_path}/{state}").awaitTermination()

    def found(word):
        hits = index.postings.bm25(spark.createDataFrame([(1, word)], "query_id int, query string"), ["file_id"])
        return {r.path for r in hits.join(index.files.read(), "file_id").select("path").collect()}

    send("one", (1, 1, "changed", "/a"), (2, 2, "changed", "/b"))
    send("one", (3, 3, "deleted", "/b"))
    index.postings.update(index.chunks.read().withColumn("text", F.lit("lost")))
    assert index.postings.backfill(index.chunks.read()) == 1
    send("one", (4, 4, "changed", "/c"))
    assert found("delta") == {"/c"} and found("words") == {"/a", "/c"} and found("lost") == set()
    send("two", (5, 5, "changed", "/d"))
    assert found("epsilon") == {"/d"} and index.files.read().count() == 3
    index.compact()
    index.compact()
    send("two", (6, 6, "deleted", "/a"))
    assert found("words") == {"/c"} and len(index.chunks.updates()) == 2
    index.compact()
    assert found("words") == {"/c"} and index.chunks.read().count() == 2


def test_a_lost_driver_leaves_kept_tables_whole(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "file_id long, x string")
    table = store.Kept(spark, f"{tmp_path}/t", "file_id long, x string")
    now = lambda: sorted(map(tuple, table.read().collect()))
    table.update(rows((1, "a"), (2, "b")), key="first")
    rows((1, "half")).write.parquet(f"{tmp_path}/t/segments/v={table._claim()}")  # lost before its commit
    assert now() == [(1, "a"), (2, "b")]
    table.update(rows((2, "c")), rows((1, "")).select("file_id"))
    n = table._claim()
    table.read().write.parquet(f"{tmp_path}/t/segments/v={n}")  # a compaction that is lost before its commit
    assert now() == [(2, "c")]
    table._fs.createNewFile(table._path(f"{tmp_path}/t/commits/{n}..2"))  # one that is lost after it
    assert now() == [(2, "c")] and table.updates() == [n]
    table.update(rows((3, "d")))
    table.compact()
    assert now() == [(2, "c"), (3, "d")] and sorted(table._names("segments")) == ["v=1", "v=5"]  # the half one was never finished
    table.update(rows((1, "again")), key="first")
    assert now() == [(2, "c"), (3, "d")]  # still known by its key


def test_moves_are_a_deletion_and_a_change(spark):
    rows = spark.createDataFrame([(1, 1, "moved", "/a", "/b"), (2, 2, "changed", "/c", None)], "ts long, event_id long, kind string, path string, dest string")
    assert sorted((r.kind, r.path) for r in watch.moved(rows).collect()) == [("changed", "/b"), ("changed", "/c"), ("deleted", "/a")]


def test_folder_scan(spark, tmp_path):
    for name in ("a.txt", "sub/b.TAR.GZ", "sub/c.py", "d.pptx", "noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda **kw: sorted(r.path.rpartition("/")[2] for r in extract.scan_folder(spark, str(tmp_path), **kw).collect())
    assert names() == ["a.txt", "b.TAR.GZ", "d.pptx"] and names(recursive=False) == ["a.txt", "d.pptx"]
