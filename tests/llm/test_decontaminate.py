import random

from tidemark.llm import decontaminate
from tidemark.llm.scratch import Scratch

ITEM = "A train leaves with Alice and travels 120 km in 3 hours, then Alice rests for 45 minutes before it goes on. How fast was the train?"
SWAPPED = ITEM.replace("Alice", "Bob Marley").replace("120", "300").replace("3 h", "7 h").replace("45", "20")
MUDDLED = "A train leaves with Carol and travels 120 km in 3 hours, then Dave rests for 45 minutes before it goes on. How fast was the train?"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


def run(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.reparameterised) for r in decontaminate.leaks(d, b, Scratch(spark, "t")).collect()}


def test_copies_and_exchanged_slots_are_caught_and_others_left_alone(spark):
    rng = random.Random(2)
    docs = [(1, words(rng, 60) + " " + ITEM + " " + words(rng, 50)), (2, words(rng, 9) + ". " + SWAPPED), (3, words(rng, 80)), (4, ITEM.upper().replace(" ", "\n")), (5, " ".join(ITEM.split()[:9]))]
    assert run(spark, docs[:3] + docs[4:], [(7, ITEM), (8, words(rng, 30))]) == {(1, 7, False), (2, 7, True)}


def test_slots_must_be_consistent():
    assert decontaminate.consistency(ITEM, ITEM) == (1.0, 8, True)
    assert decontaminate.consistency(SWAPPED, ITEM)[0] == 1.0
    twice = "the red fox saw Alice and the red fox met Alice near the old mill where Alice sang"
    assert decontaminate.consistency(twice.replace("Alice", "Bob"), twice) == (1.0, 3, False)
    mixed = "the red fox saw Ann and the red fox met Bob near the old mill where Cid sang"
    assert decontaminate.consistency(mixed, twice)[0] < decontaminate.CONSISTENT


def test_both_joins_agree(spark, monkeypatch):
    rng = random.Random(5)
    items = [(k, words(rng, rng.randint(3, 30))) for k in range(20)]
    docs = [(n, words(rng, 40) + " " + rng.choice(items)[1] + " " + words(rng, 5)) for n in range(40)] + [(99, words(rng, 50))]
    one = run(spark, docs, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert run(spark, docs, items) == one
    assert {d for d, *_ in one} == set(range(40))


def test_edited_copies_with_most_windows_are_caught(spark):
    rng = random.Random(9)
    item = words(rng, 60)
    edited = item.split()
    edited[30] = "changed"
    assert run(spark, [(1, " ".join(edited)), (2, " ".join(item.split()[:35]))], [(1, item)]) == {(1, 1, False)}


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM), (4, "x " * 100_000)]
    items = [(7, ITEM), (7, ITEM), (8, None), (9, ""), (None, ITEM + " Tell"), (10, "!!")]
    assert run(spark, docs, items) >= {(None, 7, False), (3, 7, False)}
    assert {d for d, *_ in run(spark, docs, items)} == {None, 3}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as h", "'a' as item")
    left = decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t"))
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]


def test_names_that_start_sentences_and_short_items_are_caught(spark):
    rng = random.Random(4)
    tom = "Tom has 5 apples and 3 pears. Tom gives 2 apples to Anna. How many apples does Tom have left?"
    items = [(1, tom), (2, "How tall is Rome?"), (3, "The mill of Ghent has 9 wheels"), (4, "12 34 56 78 90 11")]
    around = lambda x: words(rng, 40) + " " + x + " " + words(rng, 40)
    docs = [(1, around("so it is. " + tom.replace("Tom", "Bob"))), (2, around("How tall is Paris?")), (3, around(items[2][1])), (4, around(items[3][1])), (5, around("12 34 56 78 90 12")), (6, around("How old is Rome?"))]
    assert run(spark, docs, items) == {(1, 1, True), (2, 2, True), (3, 3, False), (4, 4, False)}
