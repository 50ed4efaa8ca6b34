"""Vectorised text primitives over Arrow string buffers.

The functions work on the UTF-8 bytes of many texts at once, so that no Python
object is made for a word. A word is a run of bytes other than space and
0x09-0x0D; words never cross texts.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes, fixed so that hashes agree between runs.
BYTE_BASE, WORD_BASE, CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Tables that operators keep in a Python worker between tasks, by operator.
kept: dict[str, dict] = {}
_powers: dict[tuple[int, bool], np.ndarray] = {}


def trim() -> None:
    """Give memory that is free inside this worker back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def claim(operator: str) -> dict:
    """The operator's own tables in this worker; those of other operators are let go, as
    workers outlive a query and their memory is shared by all."""
    others = [name for name in kept if name != operator]
    for name in others:
        del kept[name]
    if others:
        trim()
    return kept.setdefault(operator, {})


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        steps = np.full(max(n, 1 << 16), step, dtype=U64)
        steps[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hashed:
    """Prefix sums of a sequence; ``span`` hashes any of its stretches in O(1)."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, self.n = base, len(values)
        self.sums = np.zeros(self.n + 1, dtype=U64)
        np.cumsum(values * powers(base, self.n), out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * powers(self.base, self.n + 1, True)[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


def pieces(array: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of a string array of about ``most`` bytes; a longer text is a slice of its own."""
    _, ends = buffers(array)
    at, n = 0, len(array)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield array.slice(at, to - at)
        at = to
    if not n:
        yield array


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array; a null text is empty."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


class Words:
    """The words of the texts of one slice: byte ranges, and each text's range of words."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.raw, self.ends = raw, ends
        inside = ~is_space(raw)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = np.unique(ends[(ends > 0) & (ends < len(raw))])
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, ends)  # words of text i: bounds[i] .. bounds[i+1]

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.bounds))

    def hashes(self) -> np.ndarray:
        return Hashed(self.raw.astype(U64) + U64(1), BYTE_BASE).span(self.start, self.stop)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths, laid end to end: each element's list, and its place in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def lists(counts: np.ndarray, fields: dict[str, np.ndarray]) -> pa.Array:
    """An Arrow array of lists of structs from flat columns."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    inner = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
