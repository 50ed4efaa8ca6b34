import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import changes, ranks, reports
from tidemark.operators import search as S


def made(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.randrange(300), i) for i in range(3000)] + [("one", 5, -1)]
    return spark.createDataFrame(rows, "g string, x int, id long").repartition(7)


def test_positions_are_row_numbers(spark):
    rows = made(spark)
    got = ranks.positions(rows, ["g"], F.desc("x"), F.asc("id"), parts=9)
    wanted = rows.withColumn("position", (F.row_number().over(Window.partitionBy("g").orderBy(F.desc("x"), "id")) - 1).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert ranks.positions(rows.limit(0), ["g"], F.asc("id")).collect() == []


def test_frames_look_back_across_blocks(spark):
    rows = made(spark).where("g is not null")
    window = Window.partitionBy("g").orderBy("x", "id").rowsBetween(-9, 0)
    wanted = {r.id: (round(r.mean, 9), r.n) for r in rows.select("id", F.avg("x").over(window).alias("mean"), F.count("*").over(window).alias("n")).collect()}
    placed = ranks.positions(rows, ["g"], F.asc("x"), F.asc("id"), parts=5)
    for block in (1, 16, 1000):
        got = ranks.frames(placed, ["g"], "position", 9, block, mean=lambda w: F.avg("x").over(w), n=lambda w: F.count("*").over(w))
        assert {r.id: (round(r.mean, 9), r.n) for r in got.collect()} == wanted


def test_no_window_holds_a_group(spark):
    rows = made(spark)
    for found in (reports.nearest_rank(rows, "g", "x", p=0.5), reports.rolling_mean(rows, "g", "x", ["id"], 100), S.ranked_files(rows.select(F.lit(1).alias("query_id"), F.col("id").alias("file_id"), F.lit(0).alias("ordinal"), F.col("x").alias("score")))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("__part" in w or "__block" in w or "file_id" in w for w in windows), windows


def test_roots_are_joined_by_equality(spark):
    paths = ["/a", "/a/b/c.txt", "/ab/c", "/", "", "/a//x", "rel/y", None]
    roots = ["/a", "/a/b", "", "/a/", "rel", "rel/y"]
    files = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_id int, path string")
    many = spark.createDataFrame([(r,) for r in [*roots, *(f"/r{i}" for i in range(5000)), "/a"]], "root string")
    found = changes.under_roots(files, many)
    assert sorted((r.file_id, r.root) for r in found.collect()) == sorted((i, r) for i, p in enumerate(paths) if p is not None for r in roots if p == r or p.startswith(r + "/"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_repairs_leave_nothing_to_do(spark):
    schema = "path string, mtime double, size_bytes long"
    files, listing = spark.createDataFrame([("/a", 1.0, 1), ("/b", 1.0, 1), ("/c", None, 1)], schema), spark.createDataFrame([("/b", 2.0, 1), ("/c", None, 1), ("/d", 1.0, 1)], schema)
    found = changes.repairs(files, listing)
    assert sorted(map(tuple, found.collect())) == [("/a", "delete"), ("/b", "index"), ("/d", "index")]
    after = changes.delete(files, found, "path").unionByName(listing.join(found.where("action = 'index'"), "path", "left_semi"))
    assert changes.repairs(after, listing).count() == 0
