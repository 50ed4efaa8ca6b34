"""Best-fit packing of documents into training sequences with several capacities.

Tokenising. Words (runs of bytes other than space and 0x09-0x0D) are encoded once and
kept in a bounded table per worker; the tokenizers accepted here never join characters
across white space, so a text's ids are its words' ids end to end. Each document ends
with one separator id. Only documents longer than a sequence are cut.

Packing. Pieces are dealt at random to groups of about ``GROUP`` rows, each packed by
one task: longest first, into the open sequence that is best by the residual norm (or
the weighted dot product) over the residual capacities of tokens, documents and
attention cost (the sum of squared lengths), among those where all three fit. A group
leaves a handful of sequences partly filled, out of thousands.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.bytewise import lists, ragged
from tidemark.llm.scratch import Scratch

GROUP = 1 << 14
CACHED_WORDS = 1_000_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and the weights of the three in a choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"


#: One run of Latin letters, then perhaps one run of marks: one or two units for the
#: tokenizer's splitter, whatever stands beside them.
_PLAIN = re.compile(r"[A-Za-zßàáâäçèéêëíîïñóôöùúûüÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ]+([-.,;:!?%&#$*|]+)?")


class WordEncoder:
    """Ids of words by a ``tokenizers`` file, with a table of those met so far.

    New plain words are encoded many to a string; the ids that end a unit (``</w>``)
    tell the words apart again. Other words are encoded one by one."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start = np.zeros(1 << 15, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        first = len(self.place)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[first + 1 : first + 1 + len(words)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def learn(self, words: list[bytes]) -> None:
        """``words``: distinct, none of them known."""
        plain, units, other = [], [], []
        for w in words:
            m = _PLAIN.fullmatch(t := w.decode())
            if m:
                plain.append((w, t))
                units.append(1 + (m[1] is not None))
            else:
                other.append((w, t))
        if plain:
            joined = [" ".join([t for _, t in plain[i : i + 256]]) for i in range(0, len(plain), 256)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids])[np.cumsum(units) - 1] + 1
            self._add([w for w, _ in plain], ids, np.diff(ends, prepend=0))
        if other:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([t for _, t in other], add_special_tokens=False)]
            self._add([w for w, _ in other], np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n+1 bounds of each."""
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        at = list(map(self.place.get, words))
        gaps = [i for i, k in enumerate(at) if k is None]
        if gaps:
            new = list(dict.fromkeys([words[i] for i in gaps]))
            if self.place and len(self.place) + len(new) > self.most:
                self.clear()
                new, gaps = list(dict.fromkeys(words)), range(len(words))
            self.learn(new)
            for i in gaps:
                at[i] = self.place[words[i]]
        at = np.array(at, np.int64)
        counts = self.start[at + 1] - self.start[at]
        owner, place = ragged(counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[self.start[at][owner] + place], ends[np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)]


def pieces_of(path: str, tokens: int, separator: int = 0):
    """A column function: text to its pieces (piece, start, length, ids_crc32)."""

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders = bytewise.claim("packing")
        if path not in encoders:
            encoders[path] = WordEncoder(path)
        encoder = encoders[path]
        for batch in texts:
            out = []
            for part in bytewise.pieces(batch, 1 << 20):
                raw, ends = bytewise.buffers(part)
                raw = raw.tobytes()
                ids, bounds = encoder.encode([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
                lengths = np.diff(bounds) + 1
                counts = -(-lengths // tokens)
                owner, place = ragged(counts)
                crc = []
                for i in range(len(lengths)):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(separator)).astype("<u4").tobytes()
                    crc += [zlib.crc32(own[a : a + 4 * tokens]) for a in range(0, len(own), 4 * tokens)]
                start = place * tokens
                out.append(lists(counts, {"piece": place.astype(np.int32), "start": start, "length": np.minimum(lengths[owner] - start, tokens), "ids_crc32": np.array(crc, np.int64)}))
            yield pa.concat_arrays(out)

    return of


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The sequence of each piece (0, 1, ...), longest pieces placed first.

    A piece whose own length or attention cost exceeds a capacity gets a sequence of its own."""
    most = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    weights, by_norm = np.array(capacity.weights), capacity.rule == "norm"
    order = np.argsort(-lengths, kind="stable")
    chosen = np.zeros(len(lengths), np.int64)
    least = lengths.min() if len(lengths) else 0
    residual = np.zeros((3, 1024))
    number = np.zeros(1024, np.int64)
    live = made = 0
    for k in order.tolist():
        n = float(lengths[k])
        need = np.array([n, 1.0, n * n])
        left = residual[:, :live]
        fits = (left[0] >= need[0]) & (left[1] >= need[1]) & (left[2] >= need[2])
        place = np.flatnonzero(fits)
        if len(place):
            after = left[:, place] / most[:, None]
            if by_norm:
                after -= (need / most)[:, None]
                j = place[np.argmin(weights @ (after * after))]
            else:
                j = place[np.argmax((weights * need / most) @ after)]
        else:
            if live == residual.shape[1]:
                residual = np.concatenate([residual, np.zeros_like(residual)], axis=1)
                number = np.concatenate([number, np.zeros_like(number)])
            j = live
            residual[:, j], number[j] = most, made
            live, made = live + 1, made + 1
        chosen[k] = number[j]
        residual[:, j] -= need
        if residual[0, j] < least or residual[1, j] < 1 or residual[2, j] < least * least:  # full
            live -= 1
            residual[:, j], number[j] = residual[:, live], number[live]
    return chosen


def _pack(capacity: Capacity):
    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = order.column("length").to_numpy()
        chosen = best_fit(lengths, capacity)
        by = np.argsort(chosen, kind="stable")
        ends = np.cumsum(lengths[by])
        new = np.concatenate([[True], np.diff(chosen[by]) != 0])
        base = (ends - lengths[by])[np.flatnonzero(new)][np.cumsum(new) - 1]
        offset = np.zeros(len(by), np.int64)
        offset[by] = ends - lengths[by] - base
        sequence = (order.column("g").to_numpy() << 32) + chosen
        out = order.drop_columns(["g"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: Capacity = Capacity(), separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    ``tokenizer``: path of a ``tokenizers`` file, the same on every executor. A null text
    is empty; an empty text is its separator alone. Rows with a null id and repeated rows
    are packed like others. An empty table gives no rows; other columns are dropped."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(pieces_of(tokenizer, capacity.tokens, separator)(F.coalesce(F.col(text_col), F.lit("")))))
    found = scratch.keep(found, "pieces")
    groups = max(1, -(-found.count() // GROUP))
    dealt = found.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "piece"), F.lit(groups).cast("long")))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(_pack(capacity), schema)
