"""How the sources of a language differ in their terms: an audit from mergeable byte tries.

Tries. A radix trie over the bytes of terms is held in linear form: its leaves in the order that a
traversal comes to them, which is that of the bytes (UTF-8), each with its documents and occurrences
by source. Two neighbours in this order share the path of their common prefix; merging tries merges
their leaves, and a range of prefixes is a stretch of them.

Counting. Each partition counts the terms of its documents into a trie for each language, a batch at a
time, in columns; a trie of ``LEAVES`` leaves is written out and a new one begun.

Merging. The leaves of all tries are dealt by ranges of (language, term), so that a task has a
contiguous range of prefixes, whatever prefix is common; it merges equal leaves, keeps the
terms that stand in enough documents and hands them on in blocks, in UTF-8 order.

Comparing. A block of terms meets its language's sources once. Sums over the block for each pair of
sources, and each source's best terms, are all that leaves it; Spark adds and ranks those.
All arithmetic is exact, on 64-bit numbers where these suffice and on Python's where not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import Words
from tidemark.llm.scratch import Scratch

SCALE, PRIOR = 1_000_000_000, 5
#: Leaves of a partition's trie before it is written out; leaves that are staged before they are merged; rows in
#: a step of merging; terms and leaves of a block.
LEAVES, STAGED, ROWS, BLOCK, CELLS = 2_000_000, 300_000, 1 << 16, 4096, 1 << 20
LEAF = "lang string, source string, term string, docs bigint, n bigint"
BLOCKS = "lang string, terms array<string>, at array<int>, sources array<string>, counts array<bigint>"
PARTS = "lang string, source string, part string, item string, value bigint"

#: Bytes of terms: A-Z become a-z, other letters and all bytes of longer characters stay, the rest separate terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pooled(leaves: list[pa.Table], *keys: str) -> pa.Table:
    """Leaves with equal ``keys`` become one, in any order."""
    whole = pa.concat_tables(leaves).group_by(list(keys)).aggregate([("docs", "sum"), ("n", "sum")])
    return whole.rename_columns([c.removesuffix("_sum") for c in whole.column_names])


def merged(leaves: list[pa.Table], *keys: str) -> pa.Table:
    """Leaves with equal ``keys`` become one; in the order of bytes."""
    whole = pooled(leaves, *keys)
    return whole.take(pc.sort_indices(whole, [(k, "ascending") for k in keys]))


class Trie:
    """The leaves (g, term, docs, n) of a partition; ``g`` numbers the pairs of language and source."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.staged: list[pa.Table] = []
        self.rows = self.settled = 0

    def read(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        """Count the terms of some documents."""
        raw, ends = bytewise.buffers(texts)
        raw = np.frombuffer(raw.tobytes().translate(_TERMS), np.uint8)
        words = Words(raw, ends)
        if not len(words):
            return
        offsets = np.concatenate([[0], np.cumsum(words.stop - words.start)])
        terms = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[raw != 32])).dictionary_encode()
        width = len(terms.dictionary)
        own, counts = np.unique(words.text_of * width + terms.indices.to_numpy(), return_counts=True)  # a row for each term of a document
        group = np.array([self.groups.setdefault(pair, len(self.groups)) for pair in zip(langs, sources, strict=True)])
        leaf, place = np.unique(group[own // width] * width + own % width, return_inverse=True)
        n = np.zeros(len(leaf), np.int64)
        np.add.at(n, place, counts)
        self.staged.append(pa.table({"g": leaf // width, "term": terms.dictionary.take(pa.array(leaf % width)), "docs": np.bincount(place), "n": n}))
        self.rows += len(leaf)

    def settle(self) -> None:
        self.staged = [pooled(self.staged, "g", "term")]  # a traversal, in ``leaves``, puts them in order
        self.rows = self.settled = self.staged[0].num_rows

    def leaves(self) -> Iterator[pa.RecordBatch]:
        """All leaves in the order of (language, term); the trie starts anew."""
        if self.rows:
            self.settle()
            found, pairs = self.staged[0], list(self.groups)
            g = found.column("g")
            lang, source = (pa.array([p[k] for p in pairs], pa.string()).take(g.combine_chunks()) for k in (0, 1))
            found = pa.table({"lang": lang, "source": source, "term": found.column("term").cast(pa.string()), "docs": found.column("docs"), "n": found.column("n")})
            yield from found.take(pc.sort_indices(found, [("lang", "ascending"), ("term", "ascending")])).to_batches(max_chunksize=ROWS)
        self.staged, self.rows, self.settled = [], 0, 0


_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = [pa.list_(_TYPES[t[6:-1]]) if t.startswith("array") else _TYPES[t] for _, t in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n for n, _ in fields])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        langs, sources, at = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), 0
        for piece in bytewise.pieces(batch.column("text"), 4 << 20):
            trie.read(langs[at : at + len(piece)], sources[at : at + len(piece)], piece)
            at += len(piece)
            if trie.rows > trie.settled + max(STAGED, trie.settled // 2):
                trie.settle()
                if trie.rows > LEAVES:
                    yield from trie.leaves()
    yield from trie.leaves()


def _changes(rows: pa.Table, *keys: str) -> np.ndarray:
    """Where rows start that differ from the one before."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = rows.column(k)
        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return np.flatnonzero(new)


def _merge(least: int):
    """Leaves in the order of (language, term) to blocks of kept terms."""

    def kept(rows: pa.Table) -> pa.Table:
        starts = _changes(rows, "lang", "term")
        enough = np.add.reduceat(rows.column("docs").to_numpy(), starts) >= least
        return rows.filter(pa.array(np.repeat(enough, np.diff(starts, append=rows.num_rows))))

    def blocks(rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = merged(rows, "lang", "term", "source").combine_chunks()
        starts = _changes(whole, "lang", "term")
        langs = whole.column("lang").take(pa.array(starts)).to_pylist()
        first = 0
        while first < len(starts):
            last = min(first + BLOCK, len(starts))
            while langs[last - 1] != langs[first]:
                last -= 1
            a, b = starts[first], starts[last] if last < len(starts) else whole.num_rows
            own = whole.slice(a, b - a)
            at = np.repeat(np.arange(last - first), np.diff(np.append(starts[first:last], b)))
            terms = whole.column("term").take(pa.array(starts[first:last]))
            yield _batch(BLOCKS, [langs[first]], *([x.to_pylist()] for x in (terms, pa.array(at), own.column("source"), own.column("n"))))
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, found, cells = [], 0, [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < ROWS:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks()
            last = _changes(rows, "lang", "term")[-1]  # the last term may go on in the next batch
            rest = merged([rows.slice(last)], "lang", "term", "source").select(rows.column_names).cast(rows.schema).combine_chunks()
            waiting, n = rest.to_batches(), 0
            if last:
                found.append(kept(rows.slice(0, last)))
                cells += found[-1].num_rows
            if cells >= CELLS:
                yield from blocks(found)
                found, cells = [], 0
        if sum(b.num_rows for b in waiting):
            found.append(kept(pa.Table.from_batches(waiting).combine_chunks()))
            cells += found[-1].num_rows
        if cells:
            yield from blocks(found)

    return run


def shares(counts: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    below = total + PRIOR * terms
    if counts.size and int(counts.max()) + PRIOR > (1 << 63) // SCALE - 1:
        counts = counts.astype(object)
    return 1 + ((counts + PRIOR) * SCALE) // below


def _compare(top: int):
    """Blocks with their language's sources (``groups``: source and number of occurrences; ``v``: kept
    terms) to sums of pairs, each pair once, and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lang, terms, v = row["lang"], row["terms"], row["v"]
                names = [g["source"] for g in row["groups"]]
                number = {name: k for k, name in enumerate(names)}
                counts = np.zeros((len(names), len(terms)), np.int64)
                counts[[number[s] for s in row["sources"]], row["at"]] = row["counts"]
                totals = [g["n"] for g in row["groups"]]
                p = np.stack([shares(c, n, v) for c, n in zip(counts, totals, strict=True)])
                q = shares(counts.sum(axis=0), sum(totals), v)
                for k, name in enumerate(names):
                    sums = np.abs(p[k + 1 :] - p[k]).sum(axis=1)
                    others = names[k + 1 :]
                    if others:
                        yield _batch(PARTS, [lang] * len(others), [name] * len(others), ["pair"] * len(others), others, sums.tolist())
                    above = p[k] - q
                    found = np.flatnonzero((counts[k] > 0) & (above > 0))
                    best = found[np.argsort(-above[found], kind="stable")][:top]  # terms are in UTF-8 order
                    if len(best):
                        yield _batch(PARTS, [lang] * len(best), [name] * len(best), ["term"] * len(best), [terms[i] for i in best.tolist()], above[best].tolist())

    return run


def divergence(docs: DataFrame, scratch: Scratch, least: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each pair of language and source that occurs.

    ``part`` 'pair': ``item`` is another source of the language, ``value`` the sum over the language's kept
    terms (those in ``least`` of its documents) of the difference of the two sources' shares; all ranks.
    ``part`` 'term': ``item`` is a kept term that the source has and whose share is above the language's, ``value`` by
    how much; up to rank ``top``. Ranks are by value, descending, then item, by its bytes.

    Null texts, languages and sources are empty strings, which are languages and sources like others. A source
    without terms has its rows of pairs; a language without kept terms has pairs of value 0. Repeated rows count
    as documents of their own. An empty table gives no rows; other columns are not read. Besides its output,
    which has a row for each pair, a task holds a block of terms by the sources of a language."""
    spark = docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    leaves = scratch.keep(read.mapInArrow(_count, LEAF), "leaves")
    blocks = scratch.keep(leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_merge(least), BLOCKS), "blocks")
    scratch.drop("leaves")
    groups = scratch.keep(read.select("lang", "source").distinct(), "groups")
    n = blocks.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    v = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    totals = groups.join(n, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))).alias("groups"))
    parts = scratch.keep(blocks.join(totals.join(v, "lang"), "lang").mapInArrow(_compare(top), PARTS), "parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source != item")
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(by)) for x in (pairs, parts.where("part = 'term'"))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))


#: The same rows from the table ``documents``.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // ((sum(c) OVER (PARTITION BY lang, source))::HUGEINT + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f
), l AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 5)) // ((sum(c) OVER (PARTITION BY lang))::HUGEINT + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS n FROM r)
SELECT lang, source, part, item, value, n::INTEGER AS rank FROM k WHERE part = 'pair' OR n <= 50
"""
