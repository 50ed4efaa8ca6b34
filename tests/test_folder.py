import os

from pyspark.sql import functions as F

from tidemark.sources import folder
from tidemark.streaming import watch


def write(root, name, text, mtime):
    at = root / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    os.utime(at, (mtime, mtime))


def test_a_listing_opens_no_file_and_is_parted_by_folder(spark, tmp_path):
    for k, name in enumerate(("a.txt", "x/b.txt", "x/deep/er/c.txt", "y z/ü.txt")):
        write(tmp_path, name, "t" * k, 1000 + k)
    (tmp_path / "empty").mkdir()
    folder.register(spark)
    found = spark.read.format("folder").load(str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted((str(tmp_path / n), k, 1000.0 + k) for k, n in enumerate(("a.txt", "x/b.txt", "x/deep/er/c.txt", "y z/ü.txt")))
    assert found.rdd.getNumPartitions() == 4
    assert spark.read.format("folder").option("recursive", "false").load(str(tmp_path)).count() == 1
    assert spark.read.format("folder").option("levels", "2").load(str(tmp_path)).count() == 4
    assert spark.read.format("folder").load(f"{tmp_path}/none").collect() == []


def test_changes_of_a_folder_reach_the_kept_tables(spark, tmp_path):
    root = tmp_path / "in"
    folder.register(spark)
    index, told = watch.Index(spark, f"{tmp_path}/index"), []

    def contents(paths):
        return paths.join(spark.read.format("folder").load(str(root)), "path").withColumn("text", F.lit("some words"))

    def step():
        told.clear()
        stream = spark.readStream.format("folder").option("state", f"{tmp_path}/listings").load(str(root))
        keep = lambda batch, n: told.extend(map(tuple, folder.moves(batch).select("kind", "path", "dest").collect()))
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/seen").trigger(availableNow=True).start().awaitTermination()
        return sorted((k, os.path.relpath(p, root), d and os.path.relpath(d, root)) for k, p, d in told)

    def follow(n):
        stream = spark.readStream.format("folder").option("state", f"{tmp_path}/others").load(str(root))
        watch.watch(spark, stream.select("ts", "event_id", "kind", "path"), index, contents, f"{tmp_path}/state").awaitTermination()
        return {os.path.relpath(r.path, root) for r in index.files.read().collect()}

    write(root, "a.txt", "a", 1000)
    write(root, "x/b.txt", "bb", 1001)
    write(root, "x/c.txt", "ccc", 1002)
    assert step() == [("changed", "a.txt", None), ("changed", "x/b.txt", None), ("changed", "x/c.txt", None)]
    assert follow(1) == {"a.txt", "x/b.txt", "x/c.txt"}
    write(root, "a.txt", "new", 1003)
    (root / "x/b.txt").rename(root / "moved.txt")
    (root / "x/c.txt").unlink()
    assert step() == [("changed", "a.txt", None), ("deleted", "x/c.txt", None), ("moved", "x/b.txt", "moved.txt")]
    assert follow(2) == {"a.txt", "moved.txt"}
    (root / "x").rmdir()
    write(root, "y/d.txt", "d", 1004)
    assert step() == [("changed", "y/d.txt", None)] and follow(3) == {"a.txt", "moved.txt", "y/d.txt"}
    assert step() == []


def test_a_batch_that_is_run_again_tells_the_same(tmp_path):
    root = tmp_path / "in"
    write(root, "a.txt", "a", 1000)
    reader = folder.Changes({"path": str(root), "state": f"{tmp_path}/s"})
    start, end = reader.initialOffset(), reader.latestOffset()
    first = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    write(root, "b.txt", "b", 1001)
    again = folder.Changes({"path": str(root), "state": f"{tmp_path}/s"})
    assert [r for p in again.partitions(start, end) for r in again.read(p)] == first and len(first) == 1
    later = again.latestOffset()
    assert later == {"n": 2} and [r[2:4] for p in again.partitions(end, later) for r in again.read(p)] == [("changed", str(root / "b.txt"))]
