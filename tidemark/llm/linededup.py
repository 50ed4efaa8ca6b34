"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared by their sets of character shingles (``SHINGLE`` consecutive UTF-16
units; a shorter line is one shingle). The stages:

1. Signatures. Every shingle is hashed once; ``MINS`` minima of ``hash XOR constant``
   are taken per distinct line by one grouped aggregation, combined before the shuffle,
   so a line that a third of all documents share costs one row a task.
2. Banding. Each band is a hash of four minima; lines that share a band are candidates.
   At a similarity of just 0.8 a pair misses all bands 4.5 times in a hundred, at 0.85
   1.5 times, at 0.9 0.3 times.
3. Links. Every line is compared with the most frequent line of its buckets (in buckets of
   two, with the other). Then components are formed, and only where lines of a bucket are still in different
   components are the pairs across components compared, so a bucket of copies costs a
   row a line and no pairs: in larger buckets first those in chunks of about ``FEW`` lines, which joins
   most of a group of near copies, then all that are left. Buckets are cut into chunks of about ``BLOCK``
   lines and chunks are compared with chunks, so no task holds a bucket. Pairs that agree in fewer than ``AGREE`` minima go
   (at a similarity of 0.8 fifteen in ten thousand), across components also those whose
   bitmaps bound the similarity below 0.8 (each bit that differs stands for a shingle of one side
   only, so no link is lost); of the rest the exact Jaccard similarity is taken.
4. Distributed union-find (``components``) over all verified links. Of each component
   the first occurrence, by document id and place, stays.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch

SHINGLE, SIMILARITY = 8, 0.8
#: Sixteen minima as a square; a band is a row or a column. Fixed, so that signatures
#: agree between runs.
MINS = 16
BANDS = [[4 * i + k for k in range(4)] for i in range(4)] + [[4 * k + i for k in range(4)] for i in range(4)]
#: Minima that a pair must have in common to be compared exactly; lines of a bucket that are
#: compared with each other in one group, and in the first round of a larger bucket.
AGREE, BLOCK, FEW = 8, 512, 32
#: Shingles hashed in one row, for the minima and for sets; 64-bit words of a bitmap.
STEP, SET_STEP, MAP_WORDS = 4, 16, 64
#: Pairs a task verifies.
PAIRS = 1500
BLANK = " \t\r\x0b\x0c"
#: A table of at most so many bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def _constants() -> list[int]:
    """Spread over the range, as the minimum picks the hash nearest to the constant."""
    rng = random.Random(20)
    return [(i * (1 << 64) // MINS + rng.getrandbits(58)) % (1 << 64) for i in range(MINS)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _worded(line: Column) -> Column:
    """Not blank. The left end tells it; trimming the right one takes a walk over the whole line."""
    return F.ltrim(line, F.lit(BLANK)) != ""


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line) of all lines that aren't blank, from (doc_id, text)."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.where(_worded(F.col("line")))


def _units(line: Column) -> Column:
    """Two bytes a character, so that any shingle is found by its place."""
    return F.encode(line, "UTF-16BE")


def _shingle_count(units: Column) -> Column:
    return F.greatest((F.octet_length(units) / 2).cast("int") - (SHINGLE - 1), F.lit(1))


def _shingle(units: str, i: Column) -> Column:
    """The hash of the i-th shingle, from 1."""
    return F.xxhash64(F.substring(units, 2 * i - 1, F.lit(2 * SHINGLE)))


def _runs(rows: DataFrame, units: str, step: int) -> DataFrame:
    """``rows`` with ``n``, a row for each ``step`` shingles of the n, ``i`` the first of them."""
    counted = rows.withColumn("n", _shingle_count(F.col(units)))
    return counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(step))))


def _hashes(units: str, step: int) -> list[Column]:
    """The hashes of one run; the last run repeats the last shingle as often as it needs."""
    return [_shingle(units, F.least(F.col("i") + j, F.col("n"))) for j in range(step)]


def _gather(when: Column | None = None) -> Column:
    """Of rows with an array ``h`` of hashes: one array of all (of those rows), repeats included."""
    return F.flatten(F.collect_list("h" if when is None else F.when(when, F.col("h"))))


def _hashed(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``n`` (in a line's first run only) and ``h``, the hashes of a run of ``units``. Generated
    code hashes runs several times faster than a lambda hashes an array."""
    runs = _runs(rows, "units", SET_STEP)
    return runs.select(*keep, F.when(F.col("i") == 1, F.col("n")).alias("n"), F.array(*_hashes("units", SET_STEP)).alias("h"))


def _sized(table: DataFrame, width: int) -> DataFrame:
    """``table`` (kept, of ``width`` bytes a row), to be broadcast if it is small."""
    return F.broadcast(table) if table.count() * width <= BROADCAST_BYTES else table


def signatures(lines: DataFrame) -> DataFrame:
    """(lh, occurs, m0, m1, ...) per distinct line: how often it occurs, and the last 32 bits of its minima."""
    runs = _runs(lines.select(F.xxhash64("line").alias("lh"), _units(F.col("line")).alias("units")), "units", STEP)
    hashed = runs.select("lh", "n", *[h.alias(f"h{j}") for j, h in enumerate(_hashes("units", STEP))])
    minima = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(_long(c)) for j in range(STEP)])).alias(f"m{k}") for k, c in enumerate(_constants())]
    sketch = hashed.groupBy("lh").agg(F.count("*").alias("rows"), F.max("n").alias("n"), *minima)
    last = [F.shiftright(F.shiftleft(f"m{k}", 32), 32).cast("int").alias(f"m{k}") for k in range(MINS)]
    return sketch.select("lh", F.expr(f"rows div ((n + {STEP - 1}) div {STEP})").alias("occurs"), *last)


def _bands() -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{k}") for k in band]) for b, band in enumerate(BANDS)])


def _side(minima: DataFrame, x: str) -> DataFrame:
    return minima.select(*[F.col(c).alias(x if c == "lh" else f"{c}_{x}") for c in minima.columns])


def _same(k: int) -> Column:
    return F.col(f"m{k}_a") == F.col(f"m{k}_b")


def _agree() -> Column:
    return sum((F.when(_same(k), 1).otherwise(0) for k in range(MINS)), F.lit(0)) >= AGREE


def _first_common_band() -> Column:
    return F.coalesce(*[F.when(_same(b[0]) & _same(b[1]) & _same(b[2]) & _same(b[3]), F.lit(j)) for j, b in enumerate(BANDS)])


def bitmaps(texts: DataFrame) -> DataFrame:
    """(lh, n, bits): the number of shingles and a bitmap of MAP_WORDS words in which a bit is the parity of
    the shingles of the set that fall on it, so that common shingles cancel out however long lines are."""
    runs = _hashed(texts.repartition("lh").select("lh", _units(F.col("line")).alias("units")), "lh")
    sets = runs.groupBy("lh").agg(_gather().alias("s"))
    # the generator keeps the set from being worked out again for its size
    sets = sets.select("lh", F.inline(F.array(F.struct(F.array_distinct("s").alias("s")))))
    each = sets.select("lh", F.size("s").alias("n"), F.explode("s").alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = each.groupBy("lh", "n", F.expr(f"shiftright(h, 6) & {MAP_WORDS - 1}").alias("word")).agg(F.bit_xor(bit).alias("bits"))
    one = [F.coalesce(F.max(F.when(F.col("word") == k, F.col("bits"))), F.lit(0)) for k in range(MAP_WORDS)]
    return words.groupBy("lh", "n").agg(F.array(*one).alias("bits"))


def _may_be_similar() -> Column:
    """False only if sides a and b can't reach SIMILARITY: their sets differ in at least as
    many shingles as their bitmaps do in bits."""
    words = F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(words, F.lit(0), lambda x, y: x + y)
    return differ <= (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) + 1e-9


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` (kept, each once) whose lines' exact similarity reaches SIMILARITY.
    A task gets about PAIRS pairs, as their hashed shingles are many times their texts."""
    one = lambda x: texts.select(F.col("lh").alias(x), F.col("line").alias(f"line_{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").repartition(max(8, pairs.count() // PAIRS), "a", "b")
    side = lambda second, line: F.struct(F.lit(second).alias("second"), _units(F.col(line)).alias("units"))
    lines = both.select("a", "b", F.inline(F.array(side(False, "line_a"), side(True, "line_b"))))
    lists = _hashed(lines, "a", "b", "second").groupBy("a", "b").agg(_gather(~F.col("second")).alias("s"), _gather(F.col("second")).alias("t"), F.sum("n").alias("n"))
    # the generator keeps the filter from being pushed below, where it would work the sets out again
    sized = lists.select("a", "b", "s", "t", "n", F.inline(F.array(F.struct(F.size(F.array_intersect("s", "t")).alias("k")))))
    # n counts repeated shingles too, so the first bound is exact if it holds; else the union is taken
    reaches = lambda union: F.col("k") >= SIMILARITY * union - 1e-9
    return sized.where(reaches(F.col("n") - F.col("k")) | reaches(F.size(F.array_union("s", "t")))).select("a", "b")


def _chunk(salt: int) -> Column:
    return F.pmod(F.xxhash64("lh", F.lit(salt)), "chunks")


def _every() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))


def _mixed(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, k, lh, root, main, members, chunks): the lines of buckets that hold several components;
    ``main`` is the bucket's largest."""
    placed = crowd.join(roots.withColumnRenamed("node", "lh"), "lh", "left").select("band", "k", "lh", F.coalesce("root", "lh").alias("root"), "chunks", _chunk(1).alias("x"))
    shares = placed.groupBy("band", "root").agg(F.count("*").alias("size"), F.max("chunks").alias("chunks"))
    mixed = shares.groupBy("band").agg(F.max(F.struct("size", "root")).alias("top"), F.sum("size").alias("members"), F.count("*").alias("roots"), F.max("chunks").alias("chunks"))
    mixed = mixed.where("roots > 1").select("band", F.col("top.root").alias("main"), "members", _every().alias("x"))
    return placed.join(mixed, ["band", "x"]).drop("x")


def _apart(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of lines of one bucket and different components that may be similar, each from its
    first common band and once."""
    both = _side(a, "a").join(_side(b, "b"), reduce(Column.__and__, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in by]))
    both = both.where("root_a != root_b and (root_a = main_a or root_b = main_a or a < b)")
    # bitmaps are last, and one column each: few pairs come so far
    both = both.where(_agree() & (_first_common_band() == F.col("k_a")) & _may_be_similar())
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_classes(lines: DataFrame, sketch: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): each line hash that isn't its component's least, with that least."""
    rows = sketch.select("lh", "occurs", F.posexplode(_bands()).alias("k", "band"))
    buckets = rows.groupBy("band").agg(F.min("lh").alias("a"), F.max("lh").alias("b"), F.count("*").alias("n"))
    buckets = scratch.keep(buckets.where("n > 1"), "buckets")
    scratch.release()
    couples = buckets.where("n = 2").select("a", "b")
    large = buckets.where("n > 2").select("band", F.ceil(F.col("n") / BLOCK).alias("chunks"))
    crowd = scratch.keep(rows.join(_sized(large, 16), "band"), "crowd")
    # the centre of a larger bucket: the least of its most frequent lines
    centres = crowd.groupBy("band").agg(F.max(F.struct("occurs", F.bitwise_not("lh").alias("not"))).alias("top"), F.max("chunks").alias("chunks"))
    centres = centres.select("band", F.col("top.occurs").alias("often"), F.bitwise_not("top.not").alias("centre"), _every().alias("x"))
    spokes = crowd.withColumn("x", _chunk(1)).join(centres, ["band", "x"]).where("lh != centre").groupBy("lh").agg(F.max(F.struct("often", "centre")).alias("s")).select("lh", "s.centre")
    spokes = spokes.select(F.least("lh", "centre").alias("a"), F.greatest("lh", "centre").alias("b"))
    pairs = scratch.keep(couples.union(spokes).distinct(), "pairs")
    # every line of a bucket, also one that is in no pair yet: it may be compared across components
    wanted = couples.select(F.explode(F.array("a", "b")).alias("lh")).union(crowd.select("lh"))
    wanted = scratch.keep(wanted.distinct(), "wanted")
    texts = lines.select(F.xxhash64("line").alias("lh"), "line").join(_sized(wanted, 8), "lh", "left_semi")
    texts = scratch.keep(texts.groupBy("lh").agg(F.min("line").alias("line")), "texts")
    minima = scratch.keep(sketch.drop("occurs").join(_sized(wanted, 8), "lh", "left_semi"), "minima")
    near = pairs.join(_side(minima, "a"), "a").join(_side(minima, "b"), "b").where(_agree()).select("a", "b")
    links = scratch.keep(similar(scratch.keep(near, "near"), texts), "links")
    roots = components(links, scratch)
    # what is left: pairs across components of one bucket that were not compared
    mixed = scratch.keep(_mixed(crowd, roots), "mixed")
    maps = scratch.keep(bitmaps(texts.join(mixed.select("lh").distinct(), "lh", "left_semi")).join(minima, "lh"), "maps")
    if mixed.where(F.col("members") > 2 * FEW).limit(1).count():
        own = mixed.where(F.col("members") > 2 * FEW).withColumn("chunks", F.ceil(F.col("members") / FEW)).withColumn("x", _chunk(2)).join(maps, "lh")
        own = scratch.keep(_apart(own, own, ["band", "x"]).join(pairs, ["a", "b"], "left_anti"), "inside")
        pairs, links = pairs.union(own), links.union(scratch.keep(similar(own, texts), "inside-links"))
        roots = components(links, scratch)
        mixed = scratch.keep(_mixed(crowd, roots), "mixed-again")
    mixed = mixed.join(maps, "lh")
    strays = mixed.where("root != main").withColumn("x", _chunk(1)).withColumn("y", _every())
    others = mixed.withColumn("x", _every()).withColumn("y", _chunk(1))
    across = scratch.keep(_apart(strays, others, ["band", "x", "y"]).join(pairs, ["a", "b"], "left_anti"), "across")
    more = scratch.keep(similar(across, texts), "more-links")
    scratch.release()
    if more.limit(1).count():
        roots = components(links.union(more), scratch)
    scratch.drop("buckets", "crowd", "pairs", "wanted", "texts", "minima", "maps", "mixed", "mixed-again", "near", "links", "inside", "inside-links", "across", "more-links")
    return roots


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, gone): the places (from 0) of the lines that go."""
    lines = lines_of(docs)
    sketch = scratch.keep(signatures(lines.select("line")), "signatures")
    scratch.release()
    roots = line_classes(lines.select("line"), sketch, scratch)
    listed = sketch.where("occurs > 1").select("lh").union(roots.select("node")).union(roots.select("root")).distinct()
    listed = listed.join(roots.withColumnRenamed("node", "lh"), "lh", "left").select("lh", F.coalesce("root", "lh").alias("root"))
    listed = scratch.keep(listed, "listed")
    at = lines.select(F.xxhash64("line").alias("lh"), "doc_id", "text_hash", "pos")
    places = scratch.keep(at.join(_sized(listed, 16), "lh").drop("lh"), "places")
    scratch.release()
    stays = places.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("at"))
    stays = stays.select(F.col("at.doc_id").alias("id"), F.col("at.text_hash").alias("hash"), F.col("at.pos").alias("place"))
    # places are all different, so a line that very many documents hold is no hot key here
    stay = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & (F.col("pos") == F.col("place"))
    gone = places.join(stays, stay, "left_anti")
    gone = scratch.keep(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone")), "gone")
    scratch.drop("signatures", "listed", "places")
    scratch.release()
    return gone


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their text without the lines that go, and the numbers
    ``n_lines`` and ``n_removed`` of lines that aren't blank (these two replace columns of
    the same name).

    Blank lines stay as they are. A null text stays null and has no lines. Of a line's
    occurrences the one with the least id stays (null ids are least), then the one first
    in its text. Repeated rows (equal id and text) count as one: they lose the same lines. An
    empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = removals(docs.select(F.col(id_col).alias("doc_id"), text.alias("text")), scratch)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # a text goes through the join once: its lines are split behind it
    rows = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    out = rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    old = F.col("row").getField(text_col)
    out = out.select("row", "gone", old.alias("old"), F.split(F.coalesce(old, F.lit("")), "\n").alias("lines"))
    kept = F.array_join(F.filter("lines", lambda _, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("old")).otherwise(kept)
    total = F.size(F.filter("lines", _worded))
    columns = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rest]
    return out.select(*columns, total.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
