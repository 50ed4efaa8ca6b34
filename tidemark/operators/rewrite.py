"""Query rewriting as column expressions, so a batch of queries is rewritten in Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, hints for kinds, synonyms, how many terms the expanded query holds.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
IMAGE_HINTS = ["screenshot", "screen", "capture", "photo", "image", "picture", "pen"]
DOC_HINTS = ["invoice", "pdf", "resume", "doc", "recipe"]
SYNONYMS = {
    "invoice": ["invoice", "bill", "billing", "receipt", "payment"],
    "error": ["error", "exception", "traceback", "failed", "bug", "screenshot"],
    "screenshot": ["screenshot", "capture", "screen", "error"],
    "resume": ["resume", "cv", "curriculum"],
    "recipe": ["recipe", "cook", "ingredients", "bake"],
    "pen": ["pen", "pencil", "stationery"],
    "book": ["book", "notebook", "diary"],
}
EXPANDED = 24


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _holds(low: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [low.contains(p) for p in parts])


def kinds(query: Column) -> Column:
    """Kinds that the query's text hints at, wherever in a word the hint stands."""
    low = F.lower(query)
    return F.filter(F.array(F.when(_holds(low, IMAGE_HINTS), "image"), F.when(_holds(low, DOC_HINTS), "doc")), lambda x: x.isNotNull())


def date_range(query: Column, today: Column) -> Column:
    """struct(date_from, date_to) in epoch seconds (UTC): "last month", else the first month of
    the year whose name the query holds; nulls without either."""
    low, first = F.lower(query), F.trunc(today, "month")
    start = F.when(low.contains("last month"), F.add_months(first, -1))
    end = F.when(low.contains("last month"), first)
    year = F.trunc(today, "year")
    for i, month in enumerate(MONTHS):
        start = start.when(low.contains(month), F.add_months(year, i))
        end = end.when(low.contains(month), F.add_months(year, i + 1))
    seconds = lambda d: (F.datediff(d, F.lit("1970-01-01").cast("date")) * 86400).cast("double")
    return F.struct(seconds(start).alias("date_from"), seconds(end).alias("date_to"))


def terms(query: Column) -> Column:
    """The query's words and the synonyms its text triggers, sorted, each once; the query itself
    where that is nothing."""
    q = F.trim(query)
    low = F.lower(q)
    own = F.regexp_extract_all(low, F.lit(r"(?U)[\w']+"), 0)
    more = [F.when(low.contains(key), _strings(values)).otherwise(_strings([])) for key, values in SYNONYMS.items()]
    found = F.array_sort(F.array_distinct(F.concat(own, *more)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(q))


def expanded(found: Column) -> Column:
    return F.array_join(F.slice(found, 1, EXPANDED), " ")


def rewritten(queries: DataFrame, today: Column, answers: Column | None = None) -> DataFrame:
    """``queries`` (query, ...) with terms, expanded, kinds, date_from, date_to and backend. With
    ``answers``, a model's one-line answer to each query, its terms and kind are added; one that
    can't be read changes nothing."""
    rows = queries.withColumn("terms", terms(F.col("query"))).withColumn("kinds", kinds(F.col("query"))).withColumn("dates", date_range(F.col("query"), today))
    rows = rows.withColumn("answer", answered(answers, F.col("terms")) if answers is not None else F.lit(None).cast("struct<terms:array<string>,kind:string>"))
    told = F.col("answer").isNotNull()
    rows = rows.withColumn("terms", F.when(told, F.array_sort(F.array_union("terms", "answer.terms"))).otherwise(F.col("terms")))
    more = told & F.col("answer.kind").isNotNull()
    rows = rows.withColumn("kinds", F.when(more, F.array_union("kinds", F.array("answer.kind"))).otherwise(F.col("kinds")))
    rows = rows.withColumn("backend", F.when(told, "model").otherwise("regex")).withColumn("expanded", expanded(F.col("terms")))
    return rows.select("*", "dates.*").drop("dates", "answer")


def answered(answer: Column, known: Column) -> Column:
    """struct(terms, kind) of a model's answer, null if it says nothing of use.

    What follows a closed thinking block counts, and of that the first line that isn't blank; an
    open block is no answer. A line's end may name a kind after a bar; bars and commas part the
    terms. A term keeps letters, digits, apostrophes and spaces, is 2 to 24 characters long,
    starts with a letter, and adds a word that ``known`` doesn't hold."""
    heard = F.when(answer.contains("</think>"), F.regexp_extract(answer, r"(?s)</think>(.*)$", 1)).when(~answer.contains("<think>"), answer)
    line = F.trim(F.get(F.filter(F.split(heard, r"\R"), lambda x: F.trim(x, F.lit(" \t")) != ""), F.lit(0)), F.lit(" \t"))
    end = F.nullif(F.regexp_extract(line, r"\|\s*(image|doc)\s*$", 1), F.lit(""))
    parts = F.split(F.regexp_replace(line, r"\|\s*(?:image|doc)\s*$", ""), "[,|]")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(F.trim(p, F.lit(" \t"))), "[^a-z0-9' ]+", "")))
    named = F.get(F.filter(clean, lambda t: t.isin("image", "doc")), F.lit(0))
    words = F.flatten(F.transform(known, lambda t: F.split(t, r"\s+")))
    new = lambda t: (F.size(F.array_except(F.filter(F.split(t, r"\s+"), lambda w: w != ""), words)) > 0) & ~F.array_contains(known, t)
    fits = F.filter(clean, lambda t: ~t.isin("image", "doc") & F.length(t).between(2, 24) & t.rlike("^[a-z]") & new(t))
    kind, found = F.coalesce(end, named), F.array_distinct(fits)
    return F.when(line.isNotNull() & ((F.size(found) > 0) | kind.isNotNull()), F.struct(found.alias("terms"), kind.alias("kind")))
