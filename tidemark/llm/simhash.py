"""SimHash near-duplicates by bit-sliced comparison.

1. Each text's fingerprint is the bitwise majority of its shingles' XXH64 values.
2. Documents with equal fingerprints collapse to one row (a grouped minimum).
3. With ``BANDS`` bands of bits and radius r, two fingerprints within r agree on at
   least ``BANDS - r`` whole bands; each choice of that many bands gives one bucket
   key. Buckets with one member are dropped.
4. Members of a bucket are compared in blocks. Bit planes are stored vertically, 64
   fingerprints to a machine word, and one pass over the planes updates all distances
   of a block with saturating carry-save counters; queries whose lanes have all left
   the radius are abandoned. A bucket larger than a block is cut into chunks and each
   pair of chunks is a block, so no task holds a bucket. A block returns a spanning
   forest of its links, never its pairs.
5. The forests are joined by distributed connected components.

``near_copies`` finds all pairs of a Jaccard similarity instead. At 0.8 a tenth to a
quarter of the bits differ, too many for bands that must agree whole: its sketch has
``SKETCH`` bits, and each of ``TABLES`` samples of ``SAMPLE`` bits is a bucket key. In a
bucket, the bit-sliced counters (in small ones, population counts) leave pairs within
``NEAR_RADIUS`` of the first 64 bits, those also within ``WIDE_RADIUS`` of all bits are judged by their exact similarity: first each text with the busiest neighbour it has,
then, where verified components still differ, all remaining pairs across them. Buckets are made of ``PARTS``
parts of the samples in turn, so that only one part's rows are on disk.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import CHECK_BASE, WORD_BASE, Hashed, Words, ragged
from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch

BANDS, BLOCK, PACK = 5, 2048, 512
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Of two texts at a similarity of 0.8 a bit agrees with probability 0.85 (0.81 for five
#: shingles), so all samples miss them with probability 0.008 (0.1), and more than
#: NEAR_RADIUS of 64 bits differ with probability 0.0003 (0.007).
SKETCH, TABLES, SAMPLE, NEAR_RADIUS = 256, 64, 16, 20
#: Of two texts at a similarity of 0.8 more than so many of all bits differ with probability
#: 2e-11 (5e-7). Of two that share nothing but a bucket, no more do with probability 1e-7.
WIDE_RADIUS = 80
#: Parts of the samples; large buckets that are broadcast.
PARTS, BROADCAST_ROWS = 2, 100_000
#: Buckets of at most so many texts are compared pair by pair, many buckets at once.
SMALL, MANY = 64, 8192
_SAMPLES = np.array([random.Random(t).sample(range(SKETCH), SAMPLE) for t in range(TABLES)])
#: The columns of a sketch; the first is compared first.
WORDS = ["fp", "w1", "w2", "w3"]
_SEEDS = np.array([random.Random(-1 - k).getrandbits(64) for k in range(SKETCH // 64)], np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned integer; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digests = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(width: int = 3, seed: int = 42):
    """A column function: text to its fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytewise.claim("simhash")
        for batch in texts:
            raw, ends = bytewise.buffers(batch)
            raw = raw.tobytes()
            found = [fingerprint(raw[a:b], width, seed) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return of


def band_masks(bands: int, radius: int) -> list[int]:
    """A mask for each choice of ``bands - radius`` of ``bands`` runs of bits."""
    edges = [64 * i // bands for i in range(bands + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(runs, bands - radius)]


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the lanes, each of ceil(n/64) words; lanes beyond n are zero."""
    n = -(-len(values) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, lanes: np.ndarray, radius: int, triangle: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, lane) at ``radius`` or fewer differing bits. With ``triangle``
    both sides are the same list and only pairs with lane < query count."""
    sliced, words = planes(lanes), -(-len(lanes) // 64)
    ids = np.arange(len(queries))
    bits = np.unpackbits(queries.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    limit = ids if triangle else np.full(len(ids), len(lanes))  # lanes from here on are out
    over = np.packbits(np.arange(words * 64) >= limit[:, None], axis=1, bitorder="little").view(np.uint64)
    counts = [np.zeros_like(over) for _ in range(max(1, radius.bit_length()))]

    def beyond() -> np.ndarray:
        more, equal = over.copy(), np.full_like(over, _ALL)
        for j in reversed(range(len(counts))):
            if radius >> j & 1:
                equal &= counts[j]
            else:
                more |= equal & counts[j]
                equal &= ~counts[j]
        return more

    for first in range(0, 64, 8):
        for k in range(first, first + 8):
            carry = sliced[k] ^ (_ALL * bits[:, k].astype(np.uint64))[:, None]
            for count in counts:
                differs, carry = carry, count & carry
                count ^= differs
            over |= carry  # beyond the widest count
        alive = (beyond() != _ALL).any(axis=1)
        if not alive.all():
            ids, bits, over, counts = ids[alive], bits[alive], over[alive], [c[alive] for c in counts]
            if not len(ids):
                return ids, ids
    q, lane = np.nonzero(np.unpackbits(~beyond().view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little"))
    return ids[q], lane


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes 0..n-1 linked by (a, b): each node that isn't its component's least, with that least."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(before, root):
            break
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def _compare(radius: int):
    """Over rows (g, side, v) sorted by g: each block's forest as rows (a, b) of fingerprints.
    Whole small blocks are packed together; links across them are true links as well."""

    def block(v: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        v = v.view(np.uint64)
        if side.any():  # two chunks of one bucket
            queries, lanes = v[side == 1], v[side == 0]
            q, lane = within(queries, lanes, radius, False)
            order = np.concatenate([lanes, queries])
            child, root = forest(len(order), lane, q + len(lanes))
        else:
            order = v
            q, lane = within(order, order, radius, True)
            child, root = forest(len(order), q, lane)
        return pa.RecordBatch.from_arrays([pa.array(order[child].view(np.int64)), pa.array(order[root].view(np.int64))], names=["a", "b"])

    return _over_blocks(lambda part: block(np.ascontiguousarray(part[:, 2]), part[:, 1]))


def _over_blocks(block: Callable[[np.ndarray], pa.RecordBatch], pack: int = PACK):
    """``block`` over the rows (g, side, ...) of each group, small groups packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # arrays of rows, the last group perhaps not complete

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[:, 0])) + 1, [len(rows)]])
            at = 0
            while at < len(starts) - 1:
                to = at + 1
                if not rows[starts[at] : starts[to], 1].any():
                    while to < len(starts) - 1 and starts[to + 1] - starts[at] <= pack and not rows[starts[to] : starts[to + 1], 1].any():
                        to += 1
                part = rows[starts[at] : starts[to]]
                if len(part) > 1:
                    yield block(part)
                at = to

        for batch in batches:
            held.append(np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) < 8 * BLOCK:
                continue
            rows = np.concatenate(held)
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            yield from flush(rows[:last])
            held = [rows[last:]]
        if held:
            yield from flush(np.concatenate(held))

    return run


def _dealt(members: DataFrame, node: str, *rest: str) -> DataFrame:
    """``members`` (fp, key, chunks, ...) as rows (g, side, v, *rest) of blocks, by chunks of ``node``."""
    own = F.pmod(F.xxhash64(node, F.lit(1)), "chunks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return members.select("fp", "key", *rest, own.alias("own"), other.alias("other")).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long").alias("side"), F.col("fp").alias("v"), *rest
    )


def link(prints: DataFrame, scratch: Scratch, radius: int = 2) -> DataFrame:
    """``prints`` (fp long): distinct fingerprints, not null. Returns (node, root): each
    fingerprint that isn't the least of its component, with that least."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for i, m in enumerate(band_masks(BANDS, radius))])
    rows = prints.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = rows.join(sizes, "key").select("fp", "key", F.ceil(F.col("n") / BLOCK).alias("chunks"))
    blocks = _dealt(members, "fp")
    edges = blocks.repartition("g").sortWithinPartitions("g", "side").mapInArrow(_compare(radius), "a long, b long")
    return components(edges, scratch)


def near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """One row per input row: (id, text_hash, fingerprint long, component_id).
    ``component_id`` is the smallest id reachable by links of ``radius`` or fewer
    differing bits.

    A null or empty text has fingerprint zero, and all such rows are linked. Rows with
    a null id take part and get their component's smallest non-null id (null if there
    is none). Repeated rows are kept. An empty table gives no rows. Other columns of
    ``docs`` aren't looked at, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), fingerprints(width)(text).alias("fp"))
    seen = scratch.keep(seen, "fingerprints")
    least = seen.groupBy("fp").agg(F.min("doc").alias("least"))
    roots = link(least.select("fp"), scratch, radius)
    least = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = least.select("fp", "root").join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return seen.join(classes, "fp").select(F.col("doc").alias(id_col), "text_hash", F.col("fp").alias("fingerprint"), "component_id")


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's set of shingles, end to end, and their n+1 bounds.
    A text of fewer than ``width`` words is one shingle; one without words has none."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    raw, ends = bytewise.buffers(texts)
    words = Words(lower[raw], ends)
    counts = np.diff(words.bounds)
    owner, place = ragged(np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64)))
    start = words.bounds[:-1][owner] + place
    end = np.minimum(start + width, words.bounds[1:][owner])
    hashes = words.hashes()
    one = Hashed(hashes, WORD_BASE).span(start, end)
    found = np.where(end - start > 1, one ^ Hashed(hashes, CHECK_BASE).span(start, end), one)  # of a single word both are equal
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The SKETCH bits of a set of shingles."""
    ones = np.zeros(SKETCH, np.int64)
    for at in range(0, len(shingles), 1 << 13):
        hashes = bytewise.mix(shingles[at : at + (1 << 13), None] ^ _SEEDS)
        ones += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (ones * 2 > len(shingles)).astype(np.uint8)


def _sketches(width: int):
    """A column function: text to the number of its shingles and its sketch."""

    @F.arrow_udf("struct<n:int,fp:bigint,w1:bigint,w2:bigint,w3:bigint>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytewise.claim("simhash")
        for batch in texts:
            out = []
            for piece in bytewise.pieces(batch):
                found, bounds = shingle_sets(piece, width)
                bits = np.array([sketch(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint8).reshape(-1, SKETCH)
                words = np.packbits(bits, axis=1).view(np.int64)
                out.append(pa.StructArray.from_arrays([pa.array(np.diff(bounds).astype(np.int32)), *map(pa.array, words.T.copy())], names=["n", *WORDS]))
            yield pa.concat_arrays(out)

    return of


def _keys(part: int):
    """A column function: the words of a sketch to its bucket keys of one part of the samples."""
    tables = np.arange(part, TABLES, PARTS, dtype=np.int32)
    samples = _SAMPLES[tables]

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words in batches:
            bits = np.unpackbits(np.stack([np.asarray(w, dtype=np.int64) for w in words], axis=1).view(np.uint8), axis=1)
            keys = np.packbits(bits[:, samples], axis=2).view(np.uint16)[:, :, 0].astype(np.int32) | tables << SAMPLE
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * len(tables)), pa.array(keys.ravel()))

    return of


def alike(left: pa.Array, right: pa.Array, width: int, similarity: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of each two texts' sets of shingles is at least ``similarity``."""
    both = pa.concat_arrays([left, right]).dictionary_encode()  # a text of many pairs is worked out once
    sets = [shingle_sets(piece, width) for piece in bytewise.pieces(both.dictionary)]
    hashes, counts = np.concatenate([h for h, _ in sets]), np.concatenate([np.diff(bounds) for _, bounds in sets])
    text = np.asarray(both.indices)
    side, place = ragged(counts[text])
    found, owner = hashes[(np.cumsum(counts) - counts)[text][side] + place], side % len(left)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    common = np.bincount(owner[1:][(found[1:] == found[:-1]) & (owner[1:] == owner[:-1])], minlength=len(left))
    return common >= similarity * (np.bincount(owner, minlength=len(left)) - common) - 1e-9


def _alike_column(width: int, similarity: float):
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bytewise.claim("simhash")
        for left, right in batches:
            ends, at, out = bytewise.buffers(left)[1] + bytewise.buffers(right)[1], 0, [np.zeros(0, bool)]
            while at < len(left):  # a few megabytes of texts at once
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (4 << 20), "right")) - 1)
                out.append(alike(left.slice(at, to - at), right.slice(at, to - at), width, similarity))
                at = to
            yield pa.array(np.concatenate(out))

    return of


def _in_groups(g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of one group (``g`` is sorted) within NEAR_RADIUS."""
    starts = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1])
    sizes = np.diff(np.append(starts, len(g)))
    group, place = ragged(np.where(sizes <= SMALL, sizes, 0))
    b, k = ragged(place)  # each row with those before it
    a, b = starts[group[b]] + k, starts[group[b]] + place[b]
    near = np.bitwise_count(v[a] ^ v[b]) <= NEAR_RADIUS
    found = [(a[near], b[near])]
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        q, lane = within(v[start : start + size], v[start : start + size], NEAR_RADIUS, True)
        found.append((start + lane, start + q))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _near(every: bool):
    """Over rows (g, side, v, node, root, other words of the sketch): pairs (a, b) of nodes of different
    roots within NEAR_RADIUS and WIDE_RADIUS. Unless ``every``, only one for each node, with that one of its
    neighbours that has most neighbours itself, and their number."""

    def block(part: np.ndarray) -> pa.RecordBatch:
        side, v, node, root = part[:, 1], np.ascontiguousarray(part[:, 2]).view(np.uint64), part[:, 3], part[:, 4]
        if side.any():
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            q, lane = within(v[right], v[left], NEAR_RADIUS, False)
            a, b = left[lane], right[q]
        else:
            a, b = _in_groups(part[:, 0], v)
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
        apart = np.bitwise_count(v[a] ^ v[b]).astype(np.int16)
        for word in np.ascontiguousarray(part[:, 5:].T).view(np.uint64):
            apart += np.bitwise_count(word[a] ^ word[b])
        a, b = a[apart <= WIDE_RADIUS], b[apart <= WIDE_RADIUS]
        if every:
            a, b = node[a], node[b]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.zeros(pairs.shape[1], np.int64))], names=["a", "b", "often"])
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        often = np.bincount(a, minlength=len(part))
        order = np.lexsort((node[b], -often[b], a))
        first = order[np.concatenate([[True], np.diff(a[order]) > 0])] if len(order) else order
        return pa.RecordBatch.from_arrays([pa.array(node[a[first]]), pa.array(node[b[first]]), pa.array(often[b[first]])], names=["a", "b", "often"])

    return _over_blocks(block, MANY)


def _alike(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts' exact Jaccard similarity is at least ``similarity``."""
    one = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.sortWithinPartitions("a", "b").join(one("a"), "a").join(one("b"), "b")
    return both.where(_alike_column(width, similarity)("text_a", "text_b")).select("a", "b")


def near_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: (id, text_hash, component_id). ``component_id`` is the smallest
    id reachable by links of texts whose sets of ``width`` words have at least this exact
    Jaccard similarity. Bucket keys and NEAR_RADIUS are made for 0.8 and above.

    Texts without words are all linked. Null ids and repeated rows are treated as in
    ``near_duplicates``. An empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), _sketches(width)(text).alias("s")).select("doc", "text_hash", "s.*")
    seen = scratch.keep(seen.withColumn("node", F.when(F.col("n") > 0, F.col("text_hash")).otherwise(0)), "sketches")
    nodes = scratch.keep(seen.where("n > 0").groupBy("node").agg(*[F.first(w).alias(w) for w in WORDS]), "nodes")

    def rows(of: DataFrame, part: int) -> DataFrame:
        return of.select("*", F.explode(_keys(part)(*WORDS)).alias("key"))

    def candidates(placed: DataFrame, every: bool, name: str) -> DataFrame:
        out = []
        for part in range(PARTS):
            members = rows(placed, part).join(larger[part], "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1).cast("long")))
            blocks = _dealt(members, "node", "node", "root", *WORDS[1:]).repartition("g").sortWithinPartitions("g", "side")
            found = blocks.mapInArrow(_near(every), "a long, b long, often long")
            found = found.select("a", "b").distinct() if every else found.groupBy("a").agg(F.max(F.struct("often", "b")).alias("s"))
            out.append(scratch.keep(found, f"{name}{part}"))
            scratch.release()
        return reduce(DataFrame.union, out)

    def fetched(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = docs.select(F.xxhash64(text).alias("node"), text.alias("text")).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        return scratch.keep(texts, name)

    larger = []
    for part in range(PARTS):
        sizes = rows(nodes, part).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
        large = scratch.keep(sizes.select("key", F.ceil(F.col("size") / BLOCK).alias("chunks")), f"larger{part}")
        larger.append(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large)
        scratch.release()
    busiest = candidates(nodes.withColumn("root", F.col("node")), False, "busiest").groupBy("a").agg(F.max("s").alias("s"))
    pairs = scratch.keep(busiest.select(F.least("a", "s.b").alias("a"), F.greatest("a", "s.b").alias("b")).distinct(), "pairs")
    texts = fetched(pairs, "texts")
    scratch.release()
    links = scratch.keep(_alike(pairs, texts, width, similarity), "links")
    scratch.drop("texts")
    roots = components(links, scratch)
    scratch.release()
    placed = scratch.keep(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    rest = scratch.keep(candidates(placed, True, "across").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    texts = fetched(rest, "more-texts")
    scratch.release()
    more = scratch.keep(_alike(rest, texts, width, similarity), "more")
    scratch.release()
    if more.limit(1).count():
        roots = components(links.union(more), scratch)
    rooted = seen.join(roots, "node", "left").select("doc", "text_hash", F.coalesce("root", "node").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    found = scratch.keep(rooted.join(classes, "root").select(F.col("doc").alias(id_col), "text_hash", "component_id"), "copies")
    scratch.drop("sketches", "nodes", "placed", "pairs", "links", "rest", "more-texts", "more")
    scratch.drop(*[f"{name}{part}" for name in ("larger", "busiest", "across") for part in range(PARTS)])
    return found


def keep_one(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates (by ``similarity``, if given, else by
    ``radius``): of each component the row with the smallest id stays, whole and unchanged. If rows repeat that id, one of them stays.
    Rows with a null id stay only if no row of their component has an id."""
    found = near_duplicates(docs, scratch, id_col, text_col, radius, width) if similarity is None else near_copies(docs, scratch, id_col, text_col, width, similarity)
    found = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    found = found.groupBy(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("n"))
    with_id = found.where("id is not null").groupBy("id").agg(F.min(F.struct("hash", "n")).alias("s")).select("id", "s.*")
    kept = scratch.keep(with_id.unionByName(found.where("id is null").withColumn("n", F.lit(1).cast("long"))), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    out = rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    if kept.where("n > 1").limit(1).count():
        out = out.where("n = 1").unionByName(out.where("n > 1").dropDuplicates(["id"]))
    return out.select("row.*")
