"""English stems by Porter's published algorithm, as an Arrow column function over tokens.

Only tokens of 3 to 64 letters are stemmed. Each worker stems a batch's distinct tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what they become, in the order they are tried.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """Each letter as v(owel) or c(onsonant); y is a vowel after a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or x == "y" and k and out[k - 1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _hollow(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if not 3 <= len(word) <= 64:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                base = word[: -len(end)]
                if "v" in _shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif _measure(base) == 1 and _hollow(base):
                        base += "e"
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        end = _longest(word, table)
        if end and _measure(word[: -len(end)]) > 0:
            word = word[: -len(end)] + table[end]
    end = _longest(word, STEP4)
    if end:
        base = word[: -len(end)]
        if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _hollow(base):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.arrow_udf(ArrayType(StringType()))
def stemmed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        flat = batch.flatten().dictionary_encode()
        known = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
        counts = [0 if n is None else n for n in batch.value_lengths().to_pylist()]
        ends = [0]
        for n in counts:
            ends.append(ends[-1] + n)
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), known.take(flat.indices))
