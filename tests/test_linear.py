from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.plans import catalog
from tidemark.sources import store

DATA = "/root/testdata/sf0.001"


def test_rows_of_a_text_dont_carry_the_text(spark):
    plan = catalog.queries()["w_bands"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # the text is parted once; a place of each row would be a substring of the whole text
    assert "regexp_extract_all" in plan and "substring(text" not in plan


def test_grams_are_made_without_lambdas(spark):
    rows = spark.createDataFrame([(1, "Ab cd ef gh"), (2, "one"), (3, ""), (4, None), (5, "a a a a")], "id long, text string")
    found = V.hashed_features(rows, "id", "text")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    own = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    grams = rows.select("id", F.explode(V.grams(own)).alias("gram")).groupBy("id").agg(F.count("*").alias("n"))
    assert {r.id: r.n for r in grams.collect()} == {1: 9, 2: 1, 5: 9} and {r.id for r in found.collect()} == {1, 2, 5}


def test_the_words_of_a_text_are_brought_together_without_a_shuffle(spark):
    rows = [(1, 0, ["a", "b", "a"]), (1, 1, []), (2, 0, None), (3, 5, ["b", "a", "b", "b"])]
    found = spark.createDataFrame(rows, "file_id long, ordinal int, tokens array<string>").mapInArrow(store.placed, store.PLACED)
    want = {(1, 0, 3, "a", (0, 2)), (1, 0, 3, "b", (1,)), (3, 5, 4, "a", (1,)), (3, 5, 4, "b", (0, 2, 3))}
    assert {(r.file_id, r.ordinal, r.len, r.token, tuple(r.places)) for r in found.collect()} == want and found.count() == 4
