"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: a word with a digit is a number, a capitalised word inside
a sentence a name (a run of them is one), a unit word after a number a unit; other words
are lower-cased letters without marks. Windows of ``WINDOW`` tokens of the benchmark are
hash-joined with those of the documents; a document that holds at least ``SHARE`` of an
item's windows is a candidate. Its slots are then lined up with the item's: the leak
stands if equal values of the item became equal values in the document, so a question
whose numbers or names were exchanged is caught as well as a copy.

A capitalised word that starts a sentence may be a word or a name, so texts are read both
ways, and an item is found by either. Items of fewer than ``WINDOW`` tokens are looked for as a
whole at every place of a document; those whose windows have too few words by their own words.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import BYTE_BASE, CHECK_BASE, WORD_BASE, Hashed, Words, lists, ragged, signed
from tidemark.llm.scratch import Scratch

WINDOW, SHARE, CONSISTENT, LITERAL = 5, 0.8, 0.8, 2
#: At most so many distinct benchmark windows go to every worker; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
# Unit words, as they stand after a number.
UNITS = "mg g kg t mm cm m km in ft yd mi ml cl l oz lb ms s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years percent euro euros dollar dollars cent cents pound pounds meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres mile miles inch inches foot feet degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb km/h mph".split()
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = np.array([0, 0x6E756D, 0x6E616D65, 0x756E6974], np.uint64)


class Templates:
    """Template tokens of the texts of one slice: hash, kind, and the words each covers. With
    ``opening_names``, a capitalised word that starts a sentence is a name as well."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, opening_names: bool = False):
        words = Words(raw, ends)
        kind = np.zeros(256, np.uint8)  # 1 letter, 2 digit
        kind[65:91] = kind[97:123] = kind[128:] = 1
        kind[48:58] = 2
        kinds = kind[raw]
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        letters = np.flatnonzero(kinds == 1)
        place = np.concatenate([[0], np.cumsum(kinds == 1)])
        core = Hashed(lower[raw[letters]].astype(np.uint64) + np.uint64(1), BYTE_BASE).span(place[words.start], place[words.stop])
        size = place[words.stop] - place[words.start]
        digits = np.concatenate([[0], np.cumsum(kinds == 2)])
        number = digits[words.stop] > digits[words.start]
        first = raw[words.start] if len(words) else np.zeros(0, np.uint8)
        second = raw[np.minimum(words.start + 1, max(len(raw) - 1, 0))] if len(words) else first
        upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        opens = np.ones(len(words), bool)  # a sentence or a line starts here
        if len(words) > 1:
            last = raw[words.stop[:-1] - 1]
            breaks = np.concatenate([[0], np.cumsum(raw == 10)])
            opens[1:] = np.isin(last, np.frombuffer(b".!?:;|\"'", np.uint8)) | (breaks[words.start[1:]] > breaks[words.stop[:-1]])
        opens[words.bounds[:-1][np.diff(words.bounds) > 0]] = True
        owner = words.text_of
        name = upper & ~number & (size > 0)
        if not opening_names:
            name &= ~opens
        real = number | (size > 0)
        after_number = np.zeros(len(words), bool)
        after_number[1:] = number[:-1] & (owner[1:] == owner[:-1])
        unit = after_number & ~number & np.isin(core, unit_hashes())
        what = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD)))
        follows = np.zeros(len(words), bool)  # the further names of a run
        follows[1:] = (what[1:] == NAME) & (what[:-1] == NAME) & (owner[1:] == owner[:-1])
        kept = np.flatnonzero(real & ~follows)
        self.words, self.first, self.kind, self.owner = words, kept, what[kept], owner[kept]
        self.hash = np.where(self.kind == WORD, core[kept], _SLOT[self.kind])
        self.bounds = np.searchsorted(self.owner, np.arange(len(ends)))
        self.literal = np.concatenate([[0], np.cumsum(self.kind == WORD)])
        self.real, self.own = np.flatnonzero(real), (kinds, lower)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start token and text of each window; a shorter text is one window. Windows of
        fewer than LITERAL words are left out."""
        counts = np.diff(self.bounds)
        n = np.where(counts >= WINDOW, counts - WINDOW + 1, (counts > 0).astype(np.int64))
        owner, place = ragged(n)
        start = self.bounds[:-1][owner] + place
        end = np.minimum(start + WINDOW, self.bounds[1:][owner])
        return self._strong(start, end, owner)

    def _strong(self, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        strong = self.literal[end] - self.literal[start] >= np.minimum(LITERAL, end - start)
        start, end, owner = start[strong], end[strong], owner[strong]
        return signed(Hashed(self.hash, WORD_BASE).span(start, end) ^ Hashed(self.hash, CHECK_BASE).span(start, end)), start - self.bounds[:-1][owner], owner

    def spans(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``windows``, of ``length`` tokens."""
        owner, place = ragged(np.maximum(np.diff(self.bounds) - length + 1, 0))
        start = self.bounds[:-1][owner] + place
        return self._strong(start, start + length, owner)

    def literals(self, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, place, text and length of all runs of ``length`` words as they are (letters and
        digits, lower-cased); without ``length``, of each text's words as a whole."""
        kinds, lower = self.own
        place = np.concatenate([[0], np.cumsum(kinds > 0)])
        sign = Hashed(lower[self.words.raw[kinds > 0]].astype(np.uint64) + np.uint64(1), BYTE_BASE)
        word = sign.span(place[self.words.start[self.real]], place[self.words.stop[self.real]])
        bounds = np.searchsorted(self.words.text_of[self.real], np.arange(len(self.bounds)))
        counts = np.diff(bounds)
        owner, at = ragged((counts > 0).astype(np.int64) if length is None else np.maximum(counts - length + 1, 0))
        start = bounds[:-1][owner] + at
        end = bounds[1:][owner] if length is None else start + length
        return signed(Hashed(word, CHECK_BASE).span(start, end)), at, owner, end - start

    def value(self, token: int) -> bytes:
        """The words a token covers, lower-cased."""
        a = self.first[token]
        b = self.first[token + 1] if token + 1 < len(self.first) and self.owner[token + 1] == self.owner[token] else self.words.bounds[self.owner[token] + 1]
        return self.words.raw[self.words.start[a] : self.words.stop[b - 1]].tobytes().lower().strip(b".,;:!?\"'()")


_units: list[np.ndarray] = []


def unit_hashes() -> np.ndarray:
    if not _units:
        raw = [np.frombuffer(u.replace("/", "").encode(), np.uint8).astype(np.uint64) + np.uint64(1) for u in UNITS]
        _units.append(np.array([Hashed(r, BYTE_BASE).span(np.array([0]), np.array([len(r)]))[0] for r in raw], np.uint64))
    return _units[0]


def window_column(wanted: np.ndarray | None = None, short: tuple[int, ...] = (), literal: tuple[int, ...] = ()):
    """A column function: text to its windows (h, pos) in both readings, those of ``short``
    tokens and of ``literal`` words too; only those in the sorted ``wanted``, if given."""

    @F.arrow_udf("array<struct<h:bigint,pos:int>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytewise.claim("decontaminate")
        for batch in texts:
            out = []
            for piece in bytewise.pieces(batch):
                found = []
                for opening in (False, True):
                    read = Templates(*bytewise.buffers(piece), opening)
                    found += [read.windows(), *map(read.spans, short)]
                    if not opening:
                        found += [read.literals(n)[:3] for n in literal]
                if wanted is not None:
                    found = [_among(wanted, *x) for x in found]
                h, pos, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(owner, kind="stable")
                out.append(lists(np.bincount(owner, minlength=len(piece)), {"h": h[order], "pos": pos[order].astype(np.int32)}))
            yield pa.concat_arrays(out)

    return of


def _among(wanted: np.ndarray, h: np.ndarray, pos: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
    return h[hit], pos[hit], owner[hit]


def shape(item: str) -> list[tuple[int, int, int, int]]:
    """The windows (h, reading, short, literal) an item is found by. ``short`` is the number of
    tokens of a short item, ``literal`` the number of words of one without other windows."""
    reads = [Templates(*bytewise.buffers(pa.array([item])), opening) for opening in (False, True)]
    strong = [r.windows()[0].tolist() for r in reads]
    tokens = [len(r.kind) for r in reads]
    if tokens[0] < WINDOW:
        found = [(h, k, tokens[k], 0) for k in (0, 1) for h in strong[k]]
    else:
        found = [(h, k, 0, 0) for k in (0, 1) if tokens[k] >= WINDOW for h in strong[k]]
    if not strong[0]:
        h, _, _, n = reads[0].literals()
        found += [(x, 2, 0, m) for x, m in zip(h.tolist(), n.tolist(), strict=True)]
    return list(dict.fromkeys(found))


def shape_column():
    @F.arrow_udf("array<struct<h:bigint,reading:int,short:int,literal:int>>")
    def of(items: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bytewise.claim("decontaminate")
        for batch in items:
            names = ("h", "reading", "short", "literal")
            found = [[dict(zip(names, x, strict=True)) for x in shape(i)] for i in batch.to_pylist()]
            yield pa.array(found, pa.list_(pa.struct([("h", pa.int64())] + [(n, pa.int32()) for n in names[1:]])))

    return of


def consistency(document: str, item: str) -> tuple[float, int, bool]:
    """How consistently the item's slot values became values of the document where the two
    templates line up best: the share of slots that follow their value's most frequent
    counterpart, the number of slots, and whether all values are the same. Of the two
    readings the second counts if the first isn't consistent; an item that is found by its
    own words has no slots."""
    first, second = (_consistency(document, item, opening) for opening in (False, True))
    best = second if first[0] < CONSISTENT and second[0] > first[0] else first
    if best[0] < CONSISTENT:
        a, b = (Templates(*bytewise.buffers(pa.array([t]))) for t in (item, document))
        h, _, _, n = a.literals()
        if len(h) and not len(a.windows()[0]) and h[0] in b.literals(int(n[0]))[0]:
            return 1.0, 0, True
    return best


def _consistency(document: str, item: str, opening: bool) -> tuple[float, int, bool]:
    a, b = (Templates(*bytewise.buffers(pa.array([t])), opening) for t in (item, document))
    at = defaultdict(list)
    held = b.spans(len(a.kind)) if 0 < len(a.kind) < WINDOW else b.windows()
    for h, p in zip(*(x.tolist() for x in held[:2]), strict=True):
        at[h].append(p)
    offsets = Counter(q - p for h, p in zip(*(x.tolist() for x in a.windows()[:2]), strict=True) for q in at.get(h, ()))
    if not offsets:
        return 0.0, 0, False
    shift = min(offsets, key=lambda o: (-offsets[o], o))
    near = sorted((o for o in offsets if abs(o - shift) <= 3), key=lambda o: (-offsets[o], abs(o - shift)))
    pairs: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
    for i in np.flatnonzero(a.kind != WORD).tolist():
        for o in near:
            if 0 <= i + o < len(b.kind) and b.kind[i + o] == a.kind[i]:
                pairs[int(a.kind[i]), a.value(i)][b.value(i + o)] += 1
                break
    slots = sum(sum(c.values()) for c in pairs.values())
    if not slots:
        return 1.0, 0, True
    follow = sum(max(c.values()) for c in pairs.values())
    return follow / slots, slots, all(set(c) == {v} for (_, v), c in pairs.items())


def consistency_column():
    @F.arrow_udf("struct<consistent:double,slots:int,same:boolean>")
    def of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for documents, items in columns:
            found = [consistency(d, i) for d, i in zip(documents.to_pylist(), items.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.bool_())], names=["consistent", "slots", "same"])

    return of


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: (id, text_hash, item_id, n_windows, n_found,
    consistent, reparameterised). Repeated rows give one row.

    Null and empty texts and items leak nothing. Rows with a null id are judged like
    others. Items with equal ids count as one item if their texts are equal, else each for
    itself. Empty tables give no rows."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item")).where("item is not null").distinct()
    shapes = scratch.keep(items.select("item_id", "item", F.inline(shape_column()("item"))), "shapes")
    sizes = shapes.groupBy("item_id", "item", "reading").agg(F.count("*").alias("n_windows"))
    kinds = shapes.select("h").distinct()
    small = kinds.count() <= BROADCAST_WINDOWS
    wanted = np.sort(np.array([r.h for r in kinds.collect()], np.int64)) if small else None
    short, literal = (tuple(sorted(r[0] for r in shapes.where(F.col(c) > 0).select(c).distinct().collect())) for c in ("short", "literal"))
    told = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.inline(window_column(wanted, short, literal)("text"))).select("doc_id", "text_hash", "h").distinct()
    own = shapes.select("item_id", F.xxhash64("item").alias("item_hash"), "reading", "h")
    hits = told.join(F.broadcast(own) if small and own.count() <= BROADCAST_WINDOWS else own, "h")
    hits = hits.groupBy("doc_id", "text_hash", "item_id", "item_hash", "reading").agg(F.count("*").alias("n_found"))
    sizes = sizes.select(F.col("item_id").alias("own_id"), "item", "reading", "n_windows", F.xxhash64("item").alias("item_hash"))
    near = hits.join(sizes, ["item_hash", "reading"]).where(F.col("own_id").eqNullSafe(F.col("item_id"))).where(F.col("n_found") >= SHARE * F.col("n_windows"))
    # of the readings that find an item, the first
    near = near.groupBy("doc_id", "text_hash", "item_id", "item_hash", "item").agg(F.min(F.struct("reading", "n_windows", "n_found")).alias("s"))
    near = scratch.keep(near.select("doc_id", "text_hash", "item_id", "item_hash", "item", "s.n_windows", "s.n_found"), "near")
    scratch.release()
    texts = docs.select(F.col("doc_id").alias("own_id_"), "text", F.xxhash64("text").alias("own_hash_"))
    side = near if near.count() > 20_000 else F.broadcast(near)
    judged = texts.join(side, F.col("own_id_").eqNullSafe(F.col("doc_id")) & (F.col("own_hash_") == F.col("text_hash")))
    judged = judged.select("doc_id", "text_hash", "item_id", "n_windows", "n_found", consistency_column()("text", "item").alias("c")).where(F.col("c.consistent") >= CONSISTENT)
    return judged.select(F.col("doc_id").alias(id_col), "text_hash", "item_id", "n_windows", "n_found", F.col("c.consistent").alias("consistent"), (~F.col("c.same")).alias("reparameterised")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, whole and unchanged."""
    found = leaks(docs, benchmark, scratch, id_col, text_col).select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
    found = scratch.keep(found, "leaks")
    side = found if found.count() > 100_000 else F.broadcast(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("own_hash"))
    return rows.join(side, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_anti").select("row.*")
