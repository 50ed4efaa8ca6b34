"""Periodic runs of words: stretches that repeat one block at least a few times.

A run is a maximal stretch of words with a smallest period q and a length of at least
``max(least, times * q)``. Each has a Lyndon word as root, under one of the two orders of words (any
order and its reverse), that is the longest Lyndon word at the place where it starts. A
stack scanned from right to left gives that word for every place; its end, if the same word
stands there, is a candidate, which is extended to both sides by common extensions.

Extensions and comparisons of suffixes look at a few words first, then at polynomial hashes
modulo a prime by binary search. Every run is verified word by word; if that fails for one,
its stretch is done again without hashes. No suffix array is made.

In a run every word stands at least ``times`` times, so only stretches of words that
the text has so often are scanned: runs lie inside them, and end where they end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytewise
from tidemark.llm.scratch import small_batches

LEAST, TIMES = 6, 4
PRIME, BASE = (1 << 61) - 1, 0x5BD1E9955BD1E995 % ((1 << 61) - 1)
#: Words that are compared one by one before hashes are used.
NEAR = 8


class Extensions:
    """Lengths of common extensions in a list of word numbers."""

    def __init__(self, words: list[int], hashed: bool = True):
        self.words, self.hashed = words, hashed
        self.sums: list[int] | None = None

    def _prepare(self) -> None:
        self.sums, self.powers = [0], [1]
        for x in self.words:
            self.sums.append((self.sums[-1] * BASE + x + 1) % PRIME)
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def _same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _search(self, same, known: int, most: int) -> int:
        """The greatest n up to ``most`` that ``same`` holds for, doubling first; it holds for ``known``."""
        step = known
        while known + step <= most and same(known + step):
            known, step = known + step, 2 * step
        high = min(most, known + step - 1)
        while known < high:
            middle = (known + high + 1) // 2
            if same(middle):
                known = middle
            else:
                high = middle - 1
        return known

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j (i < j) on agree."""
        w, most, n = self.words, len(self.words) - j, 0
        near = most if not self.hashed else min(most, NEAR)
        while n < near and w[i + n] == w[j + n]:
            n += 1
        if n < near or n == most:
            return n
        if self.sums is None:
            self._prepare()
        return self._search(lambda k: self._same(i, j, k), n, most)

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j (i < j) agree."""
        w, most, n = self.words, i, 0
        near = most if not self.hashed else min(most, NEAR)
        while n < near and w[i - 1 - n] == w[j - 1 - n]:
            n += 1
        if n < near or n == most:
            return n
        if self.sums is None:
            self._prepare()
        return self._search(lambda k: self._same(i - k, j - k, k), n, most)


def lyndon_ends(words: list[int], extensions: Extensions) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there: the next place with a lesser suffix."""
    n = len(words)
    ends, stack = [n] * n, []
    for i in range(n - 1, -1, -1):
        x = words[i]
        while stack:
            j = stack[-1]
            y = words[j]
            if x == y:
                same = extensions.right(i, j)
                # a suffix that ends first is the lesser one
                if j + same == n or words[i + same] > words[j + same]:
                    break
            elif x > y:
                break
            stack.pop()
        if stack:
            ends[i] = stack[-1]
        stack.append(i)
    return ends


def _verified(words: list[int], start: int, end: int, period: int) -> bool:
    """Whether the stretch has the period and no neighbour extends it, word by word."""
    if words[start : end - period] != words[start + period : end]:
        return False
    return (start == 0 or words[start - 1] != words[start + period - 1]) and (end == len(words) or words[end] != words[end - period])


def stretch_runs(words: list[int], least: int = LEAST, times: int = TIMES, hashed: bool = True) -> set[tuple[int, int, int]]:
    """The runs (start, length, period) of a list of word numbers."""
    extensions = Extensions(words, hashed)
    found: set[tuple[int, int, int]] = set()
    for order in (1, -1):
        own = words if order == 1 else [-x for x in words]
        ends, latest = lyndon_ends(own, extensions if order == 1 else Turned(extensions, own)), {}
        for i in range(len(words) - 1, -1, -1):
            j = ends[i]
            if j == len(words) or words[i] != words[j]:
                continue
            period = j - i
            if latest.get(period, len(words)) <= i:  # inside the run that this period was found in last
                continue
            start, end = i - extensions.left(i, j), j + extensions.right(i, j)
            if end - start >= max(least, times * period):
                if hashed and not _verified(words, start, end, period):
                    return stretch_runs(words, least, times, hashed=False)
                latest[period] = start
                found.add((start, end - start, period))
    return found


class Turned(Extensions):
    """Extensions of the same words under the reverse order: equality, and so the hashes, are shared."""

    def __init__(self, whole: Extensions, words: list[int]):
        self.whole, self.words = whole, words

    def right(self, i: int, j: int) -> int:
        return self.whole.right(i, j)


def text_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    counts = Counter(words)
    numbers = {w: k for k, (w, c) in enumerate(counts.items()) if c >= times}
    if not numbers:
        return []
    own = np.array([numbers.get(w, -1) for w in words])
    often = np.flatnonzero(np.diff(np.concatenate([[False], own >= 0, [False]]).astype(np.int8)))
    found = []
    for a, b in zip(often[::2].tolist(), often[1::2].tolist(), strict=True):
        if b - a >= least:
            found += [(a + s, n, q) for s, n, q in stretch_runs(own[a:b].tolist(), least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def looped(words: list, seed: int | None) -> list:
    """With a seed that is divisible by 10: the words from a place on repeat a block of them, three times or more."""
    n = len(words)
    if seed is None or seed % 10 or not n:
        return words
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def _column(least: int, times: int):
    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def of(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("runs", pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))), ("collapsed", pa.string())])
        for texts, seeds in columns:
            raw, ends = bytewise.buffers(texts)
            raw, found, kept = raw.tobytes(), [], []
            for a, b, seed in zip(ends[:-1].tolist(), ends[1:].tolist(), seeds.to_pylist(), strict=True):
                words = looped(raw[a:b].split(), seed)
                runs = text_runs(words, least, times)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(collapse(words, runs).decode())
            yield pa.StructArray.from_arrays([pa.array(found, kind.field(0).type), pa.array(kept, pa.string())], fields=list(kind))

    return of


def periodic_runs(docs: DataFrame, text_col: str = "text", seed=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All rows and columns of ``docs`` with ``runs`` (array of start, length, period, in words from 0,
    by start, then period) and ``collapsed`` (the text's words, joined by one space, without those
    that a run holds after its first period). Words are runs of bytes other than space and 0x09-0x0D.

    ``seed``: a column; where it is divisible by 10 the words are looped first, see ``looped``. A null or empty text
    has no runs and collapses to an empty one. A text is one row's work, n log n in its words.
    Repeated rows get equal results; columns of these two names are replaced; an empty table stays empty."""
    small_batches(docs.sparkSession)
    found = _column(least, times)(F.coalesce(F.col(text_col), F.lit("")), (F.lit(None) if seed is None else seed).cast("bigint"))
    taken = docs.withColumns({"collapsed": found})
    return taken.withColumns({"runs": F.col("collapsed.runs"), "collapsed": F.col("collapsed.collapsed")})


def longest(runs):
    """Of a column of runs the one of the greatest length (ties: least start, then period), or null."""
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))


#: The rows of the query over ``documents``: all pairs of equal words of a text at most a quarter of it apart, maximal
#: stretches of such pairs, and of these the ones that no stretch of a smaller period contains.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS h
  FROM documents
), p AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
q AS (SELECT *, g % n AS a FROM p WHERE n > 0),
l AS (SELECT rid, n, h, w, a, 1 + (n - a) // (3 + g % 8) AS k FROM q),
t AS (SELECT rid, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % k + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM l)),
o AS (SELECT * FROM t QUALIFY count(*) OVER (PARTITION BY rid, word) >= 4),
e AS (SELECT x.rid, y.i - x.i AS q, x.i FROM o x JOIN o y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e) GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = s.rid AND b.q < s.q AND b.start <= s.start AND b.start + b.length >= s.start + s.length)),
b AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs, first(struct_pack(start, length, q) ORDER BY length DESC, start, q) AS best FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM t ANTI JOIN x USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.length // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)
"""
