"""Removal of repeated word windows, over a log-structured fingerprint index.

A window is ``width`` consecutive words of one document; a word is a run of bytes
other than space and 0x09-0x0D, unchanged. A word goes when a window that covers it
occurs anywhere else, in the same document or another.

Fingerprints. Of the ``width - GRAM + 1`` word grams of a window, the one with the
least hash is its anchor (of equals, the first). Equal windows have equal anchors, and
neighbouring windows mostly share one, so an index of anchors is about a fifteenth of
an index of windows and still misses no repeated window.

Index. Each batch of documents becomes an immutable run: one row for each distinct stretch
(the words that an anchor's windows span) with the number of its occurrences and one place,
in buckets by anchor hash and sorted inside, so that a new batch is merge-joined with all earlier runs
without moving them. When there are more than ``fanout`` runs they are merged into one, bucket
by bucket. A run may keep its texts, so later batches need no earlier documents.

Verification. Stretches of an anchor that repeats are compared by 128 bits over all their
words. Equal stretches repeat as a whole and count by a grouped sum, so a passage with many
copies costs a row a task and no pairs. Only stretches that are unlike all others (the
edges of copies), with one of each repeated kind, are compared window by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import CHECK_BASE, WORD_BASE, Hashed, Words, lists, ragged, signed
from tidemark.llm.scratch import Scratch

GRAM = 8
WIDTH = 35


def _window_starts(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of all windows, and the number of windows of each text."""
    counts = np.maximum(np.diff(words.bounds) - width + 1, 0)
    owner, place = ragged(counts)
    return words.bounds[:-1][owner] + place, counts


def _least_of(values: np.ndarray, span: int) -> np.ndarray:
    """For each i, where the least of values[i : i+span] is, the first of equals."""
    value, at, have = values, np.arange(len(values)), 1
    while have < span:
        step = min(have, span - have)
        take = value[step:] < value[:-step]
        at = np.where(take, at[step:], at[:-step])
        value = np.where(take, value[step:], value[:-step])
        have += step
    return at


def _anchor_columns(piece: pa.Array, width: int) -> pa.Array:
    words = Words(*bytewise.buffers(piece))
    starts, counts = _window_starts(words, width)
    hashed = words.hashes()
    one = Hashed(hashed, WORD_BASE)
    if len(starts):
        gram = min(GRAM, width)
        at = np.arange(len(words) - gram + 1)
        grams = one.span(at, at + gram)
        anchor = _least_of(grams, width - gram + 1)[starts]
        owner = np.repeat(np.arange(len(counts)), counts)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(owner) != 0)]))
        first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
        owner, anchor = owner[new], anchor[new]
    else:
        first = last = owner = anchor = np.zeros(0, np.int64)
        grams = np.zeros(0, np.uint64)
    base, end = words.bounds[owner], last + width
    return lists(
        np.bincount(owner, minlength=len(counts)),
        {
            "fp": signed(grams[anchor]),
            "s1": (first - base).astype(np.int32),
            "s2": (last - base).astype(np.int32),
            "h1": signed(one.span(first, end)),
            "h2": signed(Hashed(hashed, CHECK_BASE).span(first, end)),
        },
    )


def anchors(width: int):
    """A column function: text to its anchors (fp, first and last window start s1 and s2,
    and the 128-bit hash h1, h2 of the stretch)."""

    @F.arrow_udf("array<struct<fp:bigint,s1:int,s2:int,h1:bigint,h2:bigint>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.concat_arrays([_anchor_columns(piece, width) for piece in bytewise.pieces(batch)])

    return of


def _unique_ranges(spans: list[dict]) -> dict[tuple[int, int], int]:
    found: dict[tuple[int, int], int] = {}
    for s in spans:
        key = (s["s1"], s["s2"])
        found[key] = max(found.get(key, 0), s["c"])
    return found


def windows(width: int):
    """A column function: text and ranges of window starts (s1, s2, c) to each window's place, c and 128-bit hash."""

    @F.arrow_udf("array<struct<pos:int,c:bigint,w1:bigint,w2:bigint>>")
    def of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in columns:
            out, done = [], 0
            for piece in bytewise.pieces(texts):
                words = Words(*bytewise.buffers(piece))
                starts, weights, counts = [], [], []
                for i in range(len(piece)):
                    own = _unique_ranges(spans[done + i].as_py() or [])
                    counts.append(sum(b - a + 1 for a, b in own))
                    for (a, b), c in own.items():
                        starts.append(np.arange(a, b + 1) + words.bounds[i])
                        weights.append(np.full(b - a + 1, c))
                done += len(piece)
                at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
                weight = np.concatenate(weights) if weights else np.zeros(0, np.int64)
                hashed = words.hashes()
                owner = np.repeat(np.arange(len(counts)), counts)
                out.append(
                    lists(
                        np.array(counts, np.int64),
                        {
                            "pos": (at - words.bounds[owner]).astype(np.int32),
                            "c": weight,
                            "w1": signed(Hashed(hashed, WORD_BASE).span(at, at + width)),
                            "w2": signed(Hashed(hashed, CHECK_BASE).span(at, at + width)),
                        },
                    )
                )
            yield pa.concat_arrays(out)

    return of


def without():
    """A column function: text and word ranges [a, b) that go, to the numbers of words and
    the kept words joined by one space."""

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in columns:
            totals, gone, kept = [], [], []
            raw, ends = bytewise.buffers(texts)
            raw = raw.tobytes()
            for i in range(len(texts)):
                words = raw[ends[i] : ends[i + 1]].split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in ranges[i].as_py() or ():
                    edge[r["a"]] += 1
                    edge[r["b"]] -= 1
                stay = np.cumsum(edge[:-1]) == 0
                totals.append(len(words))
                gone.append(len(words) - int(stay.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode())
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["n_words", "n_removed", "kept"])

    return of


KINDS = "fp long, h1 long, h2 long, c long, text long, s1 int, s2 int"
SPAN = ["fp", "h1", "h2"]


class FingerprintIndex:
    """Immutable runs of stretches (KINDS) below ``path``, a folder that all executors share. The
    number of ``buckets`` is fixed when the first run is written. ``texts``: the documents of
    all runs as (text, words) if the caller has them at hand; else each run keeps its own."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = 4, buckets: int | None = None, texts: DataFrame | None = None):
        self.spark, self.path, self.fanout, self.given = spark, path.rstrip("/"), fanout, texts
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.buckets = self._bucket_count() or buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _bucket_count(self) -> int | None:
        runs = self.runs()
        return int(runs[0].rpartition("-of-")[2]) if runs else None

    def runs(self) -> list[str]:
        """Finished runs, oldest first."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        return [f"{self.path}/{n}" for n in names if n.startswith("run-") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]

    def _next(self) -> str:
        names = [int(r.rpartition("/run-")[2].partition("-")[0]) for r in self.runs()]
        return f"{self.path}/run-{max(names, default=-1) + 1:08d}-of-{self.buckets}"

    @staticmethod
    def _name(run: str) -> str:
        return f"stretches_{hashlib.md5(run.encode()).hexdigest()}"

    def table(self, run: str) -> DataFrame:
        """A run, in its buckets. A run that another session wrote becomes known to this one."""
        fields = ", ".join(f"{n} {t.replace('long', 'bigint')}" for n, t in (f.split() for f in KINDS.split(", ")))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(run)} ({fields}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{run}'")
        return self.spark.table(self._name(run))

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.write.format("parquet").mode("overwrite").option("path", run).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(self._name(run))

    def add(self, kinds: DataFrame, texts: DataFrame | None = None) -> str:
        """A batch's stretches (KINDS, each once), and its texts if the runs keep them, become a run."""
        run = self._next()
        if texts is not None:
            texts.write.mode("overwrite").parquet(run.replace("/run-", "/texts-"))
        self._write(kinds.repartition(self.buckets, "fp"), run)
        return run

    def texts(self) -> DataFrame:
        """(text, words) of all runs."""
        if self.given is not None:
            return self.given
        kept = [r.replace("/run-", "/texts-") for r in self.runs()]
        kept = [t for t in kept if self._fs.exists(self._at(t))]
        return self.spark.read.schema("text long, words string").parquet(*kept) if kept else self.spark.createDataFrame([], "text long, words string")

    def compact(self) -> None:
        """All runs become one by merge joins, each bucket by a task of its own; nothing is shuffled. The new run is whole before the old ones go; texts are only renamed."""
        old = self.runs()
        if len(old) < 2:
            return
        run = self._next()
        rows = self.table(old[0])
        for r in old[1:]:
            rows = _merged(rows, self.table(r))
        self._write(rows, run)
        target = run.replace("/run-", "/texts-")
        self._fs.mkdirs(self._at(target))
        for k, r in enumerate(old):
            kept = r.replace("/run-", "/texts-")
            if self._fs.exists(self._at(kept)):
                for status in self._fs.listStatus(self._at(kept)):
                    if status.getPath().getName().startswith("part-"):
                        self._fs.rename(status.getPath(), self._at(f"{target}/part-{k:05d}-{status.getPath().getName()[5:]}"))
                self._fs.delete(self._at(kept), True)
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(r)}")
            self._fs.delete(self._at(r), True)


def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one by a merge join on the anchor hash, which both are dealt and sorted by."""
    a, b = (run.select(*[F.col(f.split()[0]).alias(x + f.split()[0]) for f in KINDS.split(", ")]) for x, run in (("a_", one), ("b_", other)))
    same = (F.col("a_fp") == F.col("b_fp")) & (F.col("a_h1").bitwiseXOR(F.col("b_h1")).bitwiseOR(F.col("a_h2").bitwiseXOR(F.col("b_h2"))) == 0)
    both = a.join(b.hint("merge"), same, "full_outer")
    pick = lambda c: F.coalesce(f"a_{c}", f"b_{c}").alias(c)
    count = F.coalesce("a_c", F.lit(0)) + F.coalesce("b_c", F.lit(0))
    return both.select(pick("fp"), pick("h1"), pick("h2"), count.alias("c"), pick("text"), pick("s1"), pick("s2"))


def _split(rows: DataFrame, wanted: DataFrame, total: int) -> DataFrame:
    """Those of ``rows`` whose stretch is among ``wanted`` (SPAN, c). The stretches with more than a
    thousandth of all rows, fewer than a thousand, are broadcast, so no task gets a hot one whole."""
    hot = F.broadcast(wanted.where(F.col("c") > total / 1000).select(*SPAN))
    rest = wanted.where(F.col("c") <= total / 1000).select(*SPAN)
    return rows.join(hot, SPAN, "left_semi").unionByName(rows.join(hot, SPAN, "left_anti").join(rest, SPAN, "left_semi"))


def add_batch(batch: DataFrame, index: FingerprintIndex, scratch: Scratch, width: int = WIDTH, tag: str = "") -> DataFrame:
    """``batch`` (text, words; ``text`` the hash of the words) becomes a run, and is compared with all
    earlier runs. Returns (text, a, b): word ranges that repeat, of the batch's texts and those of
    earlier ones that only now repeat. Between the steps executors give back what the last one left
    them: Python workers and merge joins share their memory."""
    own = batch.select("text", F.inline(anchors(width)("words")))
    kinds = own.groupBy(*SPAN).agg(F.count("*").alias("c"), F.first("text").alias("text"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    earlier = [index.table(r) for r in index.runs()]
    new = index.table(index.add(kinds, None if index.given is not None else batch.select("text", "words")))
    scratch.release()
    scratch.shrink()
    # stretches whose anchor stands anywhere else; runs are in the same buckets and join as they lie
    often = new.groupBy("fp").agg(F.sum("c").alias("n"))
    seen, told = new.join(often, "fp"), F.col("n") > 1
    for k, run in enumerate(earlier):
        seen = seen.join(run.groupBy("fp").agg(F.lit(True).alias(f"in{k}")), "fp", "left")
        told = told | F.coalesce(f"in{k}", F.lit(False))
    columns = [f.split()[0] for f in KINDS.split(", ")]
    hits = seen.where(told).select(*columns, F.lit(True).alias("new"))
    for run in earlier:
        hits = hits.unionByName(run.join(new.select("fp"), "fp", "left_semi").select(*columns, F.lit(False).alias("new")))
    hits = scratch.keep(hits, f"hits{tag}")
    scratch.release()
    scratch.shrink()
    kinds = hits.groupBy(*SPAN).agg(F.sum("c").alias("c"), F.first("text").alias("text"), F.first("s1").alias("s1"), F.first("s2").alias("s2"))
    kinds = scratch.keep(kinds, f"kinds{tag}")
    again, total = kinds.where("c > 1").select(*SPAN, "c"), hits.agg(F.sum("c")).first()[0] or 0
    stretch = ["text", F.col("s1").alias("a"), (F.col("s2") + width).alias("b")]
    posts = own.select(*SPAN, "text", "s1", "s2")
    whole = _split(posts, again, total).select(*stretch)
    # an earlier stretch that stood alone so far; others were told when their batch came
    late = _split(hits.where("not new and c = 1").select(*SPAN, "text", "s1", "s2"), again, total).select(*stretch)
    whole = scratch.keep(whole.unionByName(late), f"whole{tag}")
    scratch.release()
    scratch.shrink()
    mixed = kinds.groupBy("fp").agg(F.min("c").alias("low"), F.count("*").alias("kinds")).where("low = 1 and kinds > 1").select("fp")
    fine = kinds.join(mixed, "fp", "left_semi").groupBy("text").agg(F.collect_list(F.struct("s1", "s2", "c")).alias("spans"))
    fine = index.texts().join(fine, "text").select("text", F.inline(windows(width)("words", "spans")))
    fine = scratch.keep(fine, f"windows{tag}")
    twice = fine.groupBy("w1", "w2").agg(F.sum("c").alias("n")).where("n > 1").select("w1", "w2")
    edges = fine.where("c = 1").join(twice, ["w1", "w2"], "left_semi").select("text", F.col("pos").alias("a"), (F.col("pos") + width).alias("b"))
    found = scratch.keep(whole.unionByName(edges).distinct(), f"ranges{tag}")
    scratch.drop(f"hits{tag}", f"kinds{tag}", f"whole{tag}", f"windows{tag}")
    scratch.release()
    scratch.shrink()
    if len(index.runs()) > index.fanout:
        index.compact()
    return found


def without_repeats(docs: DataFrame, scratch: Scratch, width: int = WIDTH, index: FingerprintIndex | None = None, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept). ``kept`` is the words that
    stay, joined by one space.

    Given an ``index``, windows are judged against all documents that it holds and those of
    ``docs``, which are added to it; earlier documents aren't needed again. Without one,
    ``docs`` goes in batches into an index of its own, and each window is judged against all
    of ``docs``. Null and empty texts have no
    words. Rows with a null id are judged like others; repeated rows repeat each other's
    windows, so theirs go. Texts shorter than a window stay whole. An empty table gives
    no rows. Other columns aren't looked at."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("words"))
    parts = 1 if index is not None else batches
    if index is None:
        index = FingerprintIndex(docs.sparkSession, f"{scratch.root}/index", texts=docs.select(F.xxhash64("words").alias("text"), "words"))
    found = []
    for b in range(parts):
        text = F.xxhash64("words")
        found.append(add_batch(docs.where(F.pmod(text, F.lit(parts)) == b).select(text.alias("text"), "words"), index, scratch, width, f"{b}"))
    ranges = found[0]
    for f in found[1:]:
        ranges = ranges.unionByName(f)
    ranges = ranges.groupBy("text").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    out = docs.withColumn("own", F.xxhash64("words")).join(ranges, F.col("own") == F.col("text"), "left")
    out = out.select("doc_id", without()("words", F.coalesce("ranges", F.array().cast("array<struct<a:int,b:int>>"))).alias("r"))
    return out.select(F.col("doc_id").alias(id_col), "r.n_words", "r.n_removed", "r.kept")
