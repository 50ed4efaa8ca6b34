"""Byte-level BPE: encoding and decoding with higher-order functions.

Splitting. A text is split by the pattern of the vocabulary's family, in the JVM. Its
classes are those of the encoder that the ids have to agree with (see ``LATER_LETTERS``).

Merging. A word is an array of bytes; a fold over it merges the adjacent pair of the least
rank, the leftmost of equals, until no pair has a rank. The ranks of all tokens are one literal: an array of small texts of keys and values, found by the checksum of a token's digits, so that
a lookup costs the same for each size of vocabulary. Each expression names it once.
In a long word all places of the least rank merge in one step, where no merge of lower
rank can follow from them.

Distinct words. All words of all texts are counted; the ``FREQUENT`` most frequent that occur
more than once, of at most ``SHORT`` bytes, are folded once each, and their ids go into the plan as a literal too
(a bounded table, whatever the corpus). Any other word is folded where it stands, once for
each text that holds it, so no text is shuffled and no word is a hot key.

Decoding looks up the bytes of each id and concatenates them.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

FREQUENT = 1 << 18
SHORT = 48
#: Characters of a plan's text. The driver keeps that text for its pages and log, several times, with the literal tables in it.
PLAN_TEXT = 4 << 20
#: So many of the most frequent words are looked up first, in places of their own that stay in the processor's cache.
HOT = 1 << 12

# Letters and numbers of Unicode 16.0 that Java 17, which knows Unicode 13.0, doesn't class as such.
LATER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 "
    "10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA "
    "10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF "
    "1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
LATER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
#: White space as Unicode has it; Java's own class is ASCII only.
SPACE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _later(ranges: str) -> str:
    """A class of these ranges that looks at their list only for characters beyond the first of them."""
    parts = [r.partition("-") for r in ranges.split()]
    listed = "".join(f"\\x{{{a}}}" + (f"-\\x{{{b}}}" if b else "") for a, _, b in parts)
    return f"[\\x{{{parts[0][0]}}}-\\x{{10FFFF}}&&[{listed}]]"


def java_pattern(pattern: str) -> str:
    """The splitting pattern with the classes spelled out for Java. Understands ``\\p{L}``, ``\\p{N}``,
    ``\\s`` and ``\\S`` alone, and the one negated class of these; refuses others."""
    letters, numbers, space = f"[\\p{{L}}{_later(LATER_LETTERS)}]", f"[\\p{{N}}{_later(LATER_NUMBERS)}]", f"[{SPACE}]"
    other = f"[\\P{{L}}&&\\P{{N}}&&[^{SPACE}]&&[^{_later(LATER_LETTERS)}]&&[^{_later(LATER_NUMBERS)}]]"
    found = pattern.replace(r"[^\s\p{L}\p{N}]", "\0")
    if "[" in found:
        raise ValueError(f"a class of its own in {pattern!r}")
    for old, new in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\S", f"[^{SPACE}]"), (r"\s", space), ("\0", other)):
        found = found.replace(old, new)
    return found


def words_of(text: Column, pattern: str) -> Column:
    """The matches of the pattern, in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once. The first element of a transformed array would be the same, but
    taking an element works out the type of all that is in ``then``, each time, and copies the result."""
    return F.aggregate(F.lit([]).cast("array<int>"), value, lambda x, _: x, then)


def _if(condition: Column, then: Column, otherwise: Column) -> Column:
    """As ``F.when``, which takes longer to interpret."""
    return F.call_function("if", condition, then, otherwise)


def _literal(values: list, ddl: str) -> Column:
    """A constant of the plan from JSON; the optimiser folds it once."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), ddl)


#: Parts of a table's text, in no id's symbol: before a key, between key and value, between buckets.
KEY, VALUE, BUCKET = "\ue001", "\ue002", "\ue003"


class Table:
    """A constant map from strings to strings: one text a bucket, found by the key's checksum, so that a
    lookup takes the same time at any size. ``missing``: what a key that isn't there gives. Keys
    with one of the parts' characters are left out.

    ``buckets`` is a constant of the plan. Each place that names it is a copy in the driver's memory, so
    callers bind it once (``_let``) and look up in the variable."""

    def __init__(self, entries: Iterable[tuple[str, str]], missing: str = ""):
        entries = [(k, v) for k, v in entries if not (KEY in k or VALUE in k or BUCKET in k)]
        self.n = max(1, len(entries))
        texts: list[list[str]] = [[missing] for _ in range(self.n)]
        for k, v in entries:
            texts[zlib.crc32(k.encode()) % self.n].append(f"{k}{VALUE}{v}")
        self.buckets = F.split(F.lit(BUCKET.join(KEY.join([*t, ""]) for t in texts)), BUCKET)

    def get(self, buckets: Column, key: Column) -> Column:
        """The key's value. ``buckets`` and ``key``: variables of lambdas, as the key is used more than once."""
        bucket = F.get(buckets, F.crc32(key.cast("binary")) % self.n)
        # behind the key up to the next one; without the key, what the bucket begins with
        behind = F.call_function("substring_index", bucket, F.concat(F.lit(KEY), key, F.lit(VALUE)), F.lit(-1))
        return F.substring_index(behind, KEY, 1)

    def get_character(self, buckets: Column, key: Column) -> Column:
        """The same where keys are two characters and values one, and ``missing`` is its character three times: two
        neighbours that are no parts are a key, and the value is three characters on; from place 0, where a key that isn't
        there is said to be, that is one of ``missing``."""
        bucket = F.get(buckets, F.crc32(key.cast("binary")) % self.n)
        return _let(bucket, lambda b: F.substring(b, F.position(key, b) + 3, F.lit(1)))


class Places:
    """A constant map from strings to strings that holds an entry only if no earlier one has its place, with four places for each entry."""

    def __init__(self, entries: list[tuple[str, str]]):
        self.n = 4 * max(1, len(entries))
        held: dict[int, tuple[str, str]] = {}
        for k, v in entries:
            held.setdefault(zlib.crc32(k.encode()) % self.n, (k, v))
        self.keys, self.values = (_literal([held[i][part] if i in held else None for i in range(self.n)], "array<string>") for part in (0, 1))

    def get(self, keys: Column, values: Column, key: Column, otherwise: Column) -> Column:
        place = F.crc32(key.cast("binary")) % self.n
        return _if(F.get(keys, place) == key, F.get(values, place), otherwise)


#: Above the symbols of all ids in the order of strings: no rank. What is at both ends of a word in the fold, in no pair.
NONE, EDGE = "\ue000", "\ue004"
#: Ids are characters in the fold; those from here on are no characters of their own.
MOST = 0xD800


@dataclass
class Vocabulary:
    """Ranks of byte strings, which are the ids, below ``MOST``. Every single byte needs one."""

    ranks: dict[bytes, int]

    def __post_init__(self) -> None:
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        if not all(0 <= r < MOST for r in self.ranks.values()) or len(set(self.ranks.values())) < len(self.ranks):
            raise ValueError(f"ranks must be different numbers from 0 to {MOST - 1}")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a file with a base64 token and its rank a line; read on the driver, where the path is valid."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})

    def encoder(self):
        """A function that gives another a function from a column of words to their ids, a string with the character
        of each id, and returns what that makes of it: ``encoder()(lambda encode: encode(word))``. The literal tables are bound around it.

        The fold's state: the string of ids so far between two edges (``ids``), and one with the rank of each pair of
        neighbours (``ranks``), whose least character is the next merge. A merge looks up the two
        pairs that are new."""
        pairs: dict[str, str] = {}
        settled = [True] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[chr(left) + chr(right)] = chr(rank)
                    # with all such ranks above its own, a merge to a token brings up none that comes before others of its rank
                    settled[left] &= rank > left
                    settled[right] &= rank > right
        table, settled = Table(pairs.items(), 3 * NONE), _literal(settled, "array<boolean>")
        whole = Table((token.decode("latin-1"), chr(rank)) for token, rank in self.ranks.items())
        latin, single = "".join(map(chr, range(256))), "".join(chr(self.ranks[bytes([b])] or ord(NONE)) for b in range(256))

        def bound(ranked: Column, tokens: Column):
            def rank(pair: Column) -> Column:
                return _let(pair, lambda pair: table.get_character(ranked, pair))

            def start(ids: Column) -> Column:
                def ranks(c: Column) -> Column:
                    return F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda x, y: rank(F.concat(x, y)))

                # a character of a string is found from its start, so that long ones are parted
                short = F.transform(F.sequence(F.lit(1), F.length(ids) - 1), lambda i: rank(F.substring(ids, i, F.lit(2))))
                found = _if(F.length(ids) <= SHORT + 2, short, _let(F.split(ids, ""), ranks))
                return F.struct(ids.alias("ids"), F.array_join(found, "").alias("ranks"))

            def merge_first(ids: Column, ranks: Column, least: Column) -> Column:
                def after(new: Column, k: Column) -> Column:
                    both = F.concat(rank(F.substring(new, k - 1, F.lit(2))), rank(F.substring(new, k, F.lit(2))))
                    return F.struct(new.alias("ids"), F.overlay(ranks, both, k - 1, F.lit(3)).alias("ranks"))

                return _let(F.position(least, ranks), lambda k: _let(F.overlay(ids, least, k, F.lit(2)), lambda new: after(new, k)))

            def merge_all(ids: Column, ranks: Column, least: Column) -> Column:
                flags = F.array_join(F.transform(F.split(ranks, ""), lambda r: F.when(r == least, "1").otherwise("0")), "")
                flags = F.split(F.replace(flags, F.lit("11"), F.lit("10")), "")  # of overlapping places in a row every second
                merged = _let(flags, lambda f: F.array_join(F.transform(F.split(ids, ""), lambda x, i: F.when(F.get(f, i) == "1", least).when(F.get(f, i - 1) == "1", "").otherwise(x)), ""))
                return _let(merged, start)

            def step(s: Column, _: Column) -> Column:
                ids, ranks = s["ids"], s["ranks"]

                def by(least: Column) -> Column:
                    several = (F.length(ids) > SHORT + 2) & F.get(settled, F.ascii(least))
                    merged = _if(several, merge_all(ids, ranks, least), merge_first(ids, ranks, least))
                    return _if(least == NONE, F.struct(ids.alias("ids"), F.lit("").alias("ranks")), merged)

                return _if(ranks == "", s, _let(F.array_min(F.split(ranks, "")), by))

            def fold(octets: Column) -> Column:
                ids = F.replace(F.translate(octets, latin, single), F.lit(NONE), F.lit("\0"))  # translate takes the character 0 for a deletion
                folded = F.aggregate(F.sequence(F.lit(2), F.length(octets)), _let(F.concat(F.lit(EDGE), ids, F.lit(EDGE)), start), step, lambda s: s["ids"])
                return F.replace(folded, F.lit(EDGE))

            def encode(octets: Column) -> Column:
                return _let(whole.get(tokens, octets), lambda one: _if(one != "", one, fold(octets)))

            return lambda word: _let(F.decode(word.cast("binary"), "ISO-8859-1"), encode)

        return lambda use: _let(table.buckets, lambda ranked: _let(whole.buckets, lambda tokens: use(bound(ranked, tokens))))


def frequent_words(words: DataFrame, encoder, most: int) -> list[tuple[str, str]]:
    """``words``: rows (word). The ids of the ``most`` most frequent distinct words of at most
    ``SHORT`` bytes that occur more than once, the most frequent first: a bounded table for the
    driver. Of words that occur equally often all or none."""
    if most <= 0:
        return []
    scratch = Scratch(words.sparkSession, "frequent-words")
    counted = words.where(F.octet_length("word") <= SHORT).groupBy("word").agg(F.count("*").alias("n"))
    counted = scratch.keep(counted.where("n > 1"), "counts")
    # a row for each count: as many as the root of twice the number of words at most
    least, room = 0, most
    for r in sorted(counted.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        room -= r.words
        if room < 0:
            break
        least = r.n
    found = []
    if least:
        kept = counted.where(F.col("n") >= least).repartition(4 * words.sparkSession.sparkContext.defaultParallelism)
        found = kept.select("word", "n", encoder(lambda encode: encode(F.col("word"))).alias("ids")).toArrow().to_pydict()
        found = [x[1:] for x in sorted(zip((-n for n in found["n"]), found["word"], found["ids"], strict=True))]
    scratch.drop("counts")
    scratch.release()
    return found


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text_col: str = "text", into: str = "ids", frequent: int = FREQUENT) -> DataFrame:
    """All rows and columns of ``docs`` and ``into``: the ids of the text as unsigned 32-bit integers,
    little-endian, one after the other (binary), as the public encoder for such
    vocabularies gives them without special tokens.

    A null or empty text has no ids; long texts and long words are encoded whole; repeated
    rows and other columns stay as they are. A column that is called ``into`` already is
    replaced. An empty table stays empty."""
    spark, name = docs.sparkSession, "spark.sql.maxPlanStringLength"
    now = spark.conf.get(name).rstrip("b")
    if now.isdigit() and int(now) > PLAN_TEXT:
        spark.conf.set(name, PLAN_TEXT)
    encoder, text = vocabulary.encoder(), F.col(text_col)
    words = docs.select(F.explode(words_of(text, pattern)).alias("word"))
    found = frequent_words(words, encoder, frequent)
    hot, known = Places(found[:HOT]), Table(found)

    def symbols(encode) -> Column:
        def by(keys: Column, values: Column, buckets: Column) -> Column:
            def cold(word: Column) -> Column:
                return _let(known.get(buckets, word), lambda ids: _if(ids != "", ids, encode(word)))

            return F.transform(words_of(text, pattern), lambda word: hot.get(keys, values, word, cold(word)))

        # a word that holds a part of the table's own text could be taken for other keys
        buckets = F.when(~F.coalesce(F.contains(text, F.lit(VALUE)), F.lit(False)), known.buckets)
        return F.array_join(_let(hot.keys, lambda keys: _let(hot.values, lambda values: _let(buckets, lambda b: by(keys, values, b)))), "")

    # a character and its high half, 0, of each id: in UTF-16 the four bytes of the number
    wide = _let(encoder(symbols), lambda s: _if(s != "", F.concat(F.array_join(F.split(s, ""), "\0"), F.lit("\0")), F.lit("")))
    return docs.withColumn(into, F.encode(wide, "UTF-16LE"))


def count_ids(ids: Column) -> Column:
    return F.shiftright(F.octet_length(ids), 2).cast("bigint")


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of the ids (binary, as ``encode_texts`` writes them), concatenated; null for null.
    An id without a token adds nothing."""
    found = [""] * (max(vocabulary.ranks.values()) + 1)
    for token, rank in vocabulary.ranks.items():
        found[rank] = token.decode("latin-1")
    pieces = _literal(found, "array<string>")
    # with the mark of its order of bytes before, UTF-32 has a character for each id; no ids are parted into one empty text
    symbols = F.split(F.decode(F.concat(F.lit(b"\xff\xfe\0\0"), ids), "UTF-32"), "")
    return F.encode(F.array_join(F.transform(symbols, lambda x: F.get(pieces, F.when(x != "", F.ascii(x)))), ""), "ISO-8859-1")
