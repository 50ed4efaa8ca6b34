import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bytepairs
from tidemark.llm.bytepairs import Vocabulary

PATTERN = public_tokenizers.PATTERN
FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def check(spark, texts, vocabulary, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = bytepairs.encode_texts(docs, vocabulary, PATTERN, **options).select("*", bytepairs.decode(F.col("ids"), vocabulary).alias("back"), bytepairs.count_ids(F.col("ids")).alias("n"))
    encoder = reference(vocabulary)
    for r in found.collect():
        ids = encoder.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids, (texts[r.doc_id] or "")[:80]
        assert bytes(r.back) == (texts[r.doc_id] or "").encode() and r.n == len(ids)


def test_ids_are_those_of_the_public_encoder(spark):
    rng = random.Random(11)
    pieces = ["the", " Tiger", "naïve", "x1234", "don't", "I'LL", "we've", "—", "語", "  ", "\n\n", "\t", " ", "　", "\x85", "\x1c", "\0", "!!", "...", "ⅷ", "٣", "é", "🙂", "ࡰ", "𑽐", "<|endoftext|>", "éaitiontion"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 4, 30, 300]))) for _ in range(150)]
    texts += [None, "", " ", "a", "  a", "a  ", "\n a\n", "'s", "''s", " 's"]
    check(spark, texts, Vocabulary.load(FILE))


def test_long_texts_and_long_words(spark):
    rng = random.Random(12)
    texts = ["-" * 5001, " " * 3000 + "x", "ab" * 2000, "".join(rng.choice("abc") for _ in range(3000)), "aaa" * 777 + "b", "語" * 500, "word " * 40000]
    check(spark, texts, Vocabulary.load(FILE), frequent=2)


@pytest.mark.parametrize("seed", range(3))
def test_any_vocabulary(spark, seed):
    """Also one whose ranks don't rise with the tokens they are made of: merges are then made one by one."""
    rng = random.Random(seed)
    tokens = {"".join(rng.choice("aab") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)}
    order = [bytes([b]) for b in range(256)] + sorted(tokens)
    rng.shuffle(order)
    texts = ["".join(rng.choice("aab") for _ in range(n)) for n in [1, 2, 3, 5, 8, 13, 21, 40, 60, 80, 120, 400] * 4]
    check(spark, texts, Vocabulary({token: rank for rank, token in enumerate(order)}), frequent=3)


def test_classes_of_all_characters(spark):
    """Every character is letter, number, space or other as for the public encoder."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {first + bytes([b]): 256 * (k + 1) + b for k, first in enumerate((b"a", b"1", b"!")) for b in range(256)}
    texts = ["".join(first + chr(c) for first in "a1!" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 512)]
    check(spark, texts, Vocabulary(ranks), frequent=0)


def test_tables(spark):
    vocabulary = Vocabulary.load(FILE)
    docs = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "y")], "doc_id long, text string, ids string").withColumn("word", F.lit(1))
    found = bytepairs.encode_texts(docs, vocabulary, PATTERN)
    assert found.columns == ["doc_id", "text", "ids", "word"] and len({bytes(r.ids) for r in found.collect()}) == 1 and found.count() == 3
    assert bytepairs.encode_texts(docs.limit(0), vocabulary, PATTERN).collect() == []
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        bytepairs.java_pattern("[a-z]+")


def test_query(spark):
    from tidemark.llm import registry

    found = {r.doc_id: r for r in registry.op11_bytepairs(spark, "/root/testdata/sf0.001").collect()}
    encoder = reference(Vocabulary.load(FILE))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = np.array(encoder.encode_ordinary(r.text or ""), "<u4")
        own = found[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_each_table_is_in_the_plan_once(spark):
    """Copies of the literal tables, and what each task found most frequent, filled the driver's memory."""
    vocabulary = Vocabulary.load(FILE)
    docs = spark.createDataFrame([(1, "the words of the text")], "doc_id long, text string")
    found = bytepairs.encode_texts(docs, vocabulary, PATTERN)
    plan = found._jdf.queryExecution().analyzed().toString()
    # some pair's entry, and a frequent word's
    pair = chr(vocabulary.ranks[b"t"]) + chr(vocabulary.ranks[b"h"])
    assert plan.count(f"{bytepairs.KEY}{pair}{bytepairs.VALUE}") == 1 and plan.count(f"{bytepairs.KEY}the{bytepairs.VALUE}") <= 2


def test_only_words_that_repeat_are_kept_and_ties_bound_them(spark):
    encoder = Vocabulary.load(FILE).encoder()
    words = spark.createDataFrame([(w,) for w in ["a"] * 3 + ["b"] * 2 + ["c"] * 2 + ["d"]], "word string")
    assert [w for w, _ in bytepairs.frequent_words(words, encoder, 10)] == ["a", "b", "c"]
    assert [w for w, _ in bytepairs.frequent_words(words, encoder, 2)] == ["a"]


def test_words_with_the_parts_of_a_table(spark):
    key, value, bucket = bytepairs.KEY, bytepairs.VALUE, bytepairs.BUCKET
    texts = [f"{key}!{value}", f"!{value}\0{key}!!", f"!{bucket}!", "! !!", "! !!", f"{key}!!{value}!{key}"] * 3
    check(spark, texts, Vocabulary.load(FILE))


def test_no_value_is_bound_by_taking_an_element(spark):
    """Taking an element of a transformed array works out the types of all that is in its lambda, for each word and each step of a fold."""
    docs = spark.createDataFrame([(1, "the words of the text")], "doc_id long, text string")
    found = bytepairs.encode_texts(docs, Vocabulary.load(FILE), PATTERN, frequent=0)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") > 5 and ")[0]" not in plan


def test_ids_at_the_ends_of_the_range(spark):
    """The first id is the character 0, the last one is next to those that are no characters; also without any id."""
    order = [bytes([b]) for b in range(255, -1, -1)]
    ranks = {token: rank for rank, token in enumerate(order)} | {b"ab": bytepairs.MOST - 1, b"\xff\xff": 300}
    check(spark, ["ab", "\0\0", "cabab", "", None, "é\0ab"], Vocabulary(ranks), frequent=0)
    docs = spark.createDataFrame([(bytearray(b"\0" * 8),), (bytearray(),), (None,)], "ids binary")
    back = docs.select(bytepairs.decode(F.col("ids"), Vocabulary(ranks)).alias("back")).collect()
    assert [r.back and bytes(r.back) for r in back] == [b"\xff\xff", bytearray(), None]


def test_the_text_of_a_plan_is_bounded(spark):
    """The tables' text, many times over in what the driver keeps of a plan, filled its memory on check_h."""
    docs = spark.createDataFrame([(1, "the words of the text")], "doc_id long, text string")
    bytepairs.encode_texts(docs, Vocabulary.load(FILE), PATTERN)
    assert int(spark.conf.get("spark.sql.maxPlanStringLength")) <= bytepairs.PLAN_TEXT
