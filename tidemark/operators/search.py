"""Hybrid retrieval over batches of queries: keyword ranking, vector ranking, fusion.

Every step is a DataFrame plan over (query_id, ...), so many queries share one scan. Top-k
steps rank inside a query after the rows were cut per partition (window group limit).
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.functions.stems import stemmed
from tidemark.operators.ranks import positions
from tidemark.operators.rewrite import rewritten
from tidemark.sources.shared import shared_folder

log = logging.getLogger(__name__)

K1, B, RRF = 1.2, 0.75, 60
#: A query set of at most so many rows is broadcast.
BROADCAST_QUERIES = 10_000
#: A table of terms, frequencies or results of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: Queries of at most so many distinct tokens are looked for in the texts as they are read.
SOUGHT = 10_000


def _tokens(text: Column, stems: bool) -> Column:
    return stemmed(T.tokens(text)) if stems else T.tokens(text)


def query_phrases(queries: DataFrame, stems: bool = False) -> DataFrame:
    """(query_id, phrase, weight): each run of a query's characters other than white space is a
    phrase of its tokens (``don't`` is ``don t``); a phrase named more than once counts each time."""
    words = queries.select("query_id", F.explode(T.split_words(F.col("query"))).alias("word"))
    return words.select("query_id", _tokens(F.col("word"), stems).alias("phrase")).where(F.size("phrase") > 0).groupBy("query_id", "phrase").agg(F.count("*").alias("weight"))


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, to be broadcast if it has at most so many rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def parts_of(phrases: DataFrame) -> DataFrame:
    """(phrase, n, k, token): the k-th of each phrase's n tokens."""
    return phrases.select("phrase").distinct().select("phrase", F.size("phrase").alias("n"), F.posexplode("phrase").alias("k", "token"))


def held(at: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, len, phrase, tf) of (*keys, len, phrase, n, k, pos): how often the tokens of a phrase
    stand one after the other."""
    one = at.where("n = 1").groupBy(*keys, "len", "phrase").agg(F.count("*").alias("tf"))
    run = at.where("n > 1").groupBy(*keys, "len", "phrase", "n", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("m"))
    return one.unionByName(run.where("m = n").groupBy(*keys, "len", "phrase").agg(F.count("*").alias("tf")))


def occurrences(tokens: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    """(*keys, len, phrase, tf): how often each row's ``tokens`` hold each of ``phrases`` (phrase)."""
    each = tokens.select(*keys, F.size("tokens").alias("len"), F.posexplode("tokens").alias("pos", "token"))
    return held(each.join(small(parts_of(phrases)), "token"), keys)


def score(post: DataFrame, keys: list[str], phrases: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, *keys, score) by BM25 over (*keys, len, phrase, tf) and one row (n, avg_len). The
    inverse frequency of a phrase in half the rows or more is 1e-6."""
    df = post.groupBy("phrase").agg(F.count("*").alias("df"))
    # the frequencies have a row for each of the phrases at most
    few = F.broadcast if phrases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda x: x
    scored = post.join(few(df), "phrase").crossJoin(F.broadcast(stats)).join(few(phrases), "phrase")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("query_id", *keys).agg(F.sum(F.when(idf > 0, idf).otherwise(1e-6) * part * F.col("weight")).alias("score"))


def bm25(rows: DataFrame, keys: list[str], text_col: str, queries: DataFrame, stems: bool = False) -> DataFrame:
    """(query_id, *keys, score) of all rows that hold a phrase of a query; only the queries'
    phrases become postings."""
    phrases = query_phrases(queries, stems)
    tokens = rows.select(*keys, _tokens(F.col(text_col), stems).alias("tokens"))
    sought = [r.token for r in parts_of(phrases).select("token").distinct().limit(SOUGHT + 1).collect()]
    if len(sought) <= SOUGHT:
        # each text is read once: its length and the places of the queries' tokens are written
        own = F.filter(F.transform("tokens", lambda x, i: F.struct(i.alias("pos"), x.alias("token"))), lambda x: x["token"].isin(sought))
        found = tokens.select(*keys, F.size("tokens").alias("len"), own.alias("own"))
        spark, at = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/found-{uuid.uuid4().hex}"
        found.write.parquet(at)
        found = spark.read.schema(found.schema).parquet(at)
        stats = found.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        post = held(found.select(*keys, "len", F.inline("own")).join(small(parts_of(phrases)), "token"), keys)
        return score(post, keys, phrases, stats)
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    return score(occurrences(tokens, keys, phrases), keys, phrases, stats)


def top_k(hits: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query with their ``rank`` from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_id, ordinal, score): each query (query_id, query_vec) against all vectors.
    Up to BROADCAST_QUERIES queries go to every partition; more are dealt to blocks of that
    many, and the vectors to each block."""
    asked = queries.select("query_id", V.normalised(F.col("query_vec")).alias("q"))
    own = vectors.select("file_id", "ordinal", V.normalised(F.col("vec")).alias("v"))
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        both = own.crossJoin(F.broadcast(asked))
    else:
        blocks = -(-n // BROADCAST_QUERIES)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long")))
        both = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asked, "block")
    return both.select("query_id", "file_id", "ordinal", V.dot(F.col("v"), F.col("q")).alias("score"))


def best_of_lists(*lists: DataFrame) -> DataFrame:
    """(query_id, file_id, rank, shown): the best rank from 1 of each file over ranked lists, and the
    score 60/(60 + rank - 1) it is shown with."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "file_id", "rank") for x in lists])
    best = rows.groupBy("query_id", "file_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("shown", F.round(RRF / (RRF + F.col("rank") - 1.0), 3))


def or_nothing(make: Callable[[], DataFrame], schema: str, spark: SparkSession) -> DataFrame:
    """The rows of a retriever, or none if it fails, so that the others' results still come. The
    rows are worked out here and written, as a plan fails only when it runs; what reads them
    more than once doesn't work them out again."""
    at = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
    try:
        make().select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in schema.split(", ")]).write.parquet(at)
    except Exception as e:
        log.warning("a retriever failed: %s", type(e).__name__)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(at)


def timed(action: Callable[[], object], spark: SparkSession, folder: str, backend: str = "search") -> object:
    """The action's result; how long it took is appended to the table of latencies in ``folder``,
    also if it fails."""
    began = time.perf_counter()
    try:
        return action()
    finally:
        row = [(time.time(), (time.perf_counter() - began) * 1000, backend)]
        spark.createDataFrame(row, "ts double, ms double, backend string").coalesce(1).write.mode("append").parquet(folder)


def snippets(results: DataFrame, queries: DataFrame, files: DataFrame, chunks: DataFrame, by_chunk: DataFrame, dense: DataFrame) -> DataFrame:
    """``results`` (query_id, file_id, kind, matched_via, ...) with ``snippet`` and ``snippet_source``.

    A file found by keyword shows marked words: an image its recognised text first, any other file
    its best chunk, then its recognised text. A file found by meaning only shows an image's
    recognised text from its start, else the surroundings of the query's first word in its
    nearest chunk. ``by_chunk`` and ``dense`` are ranked lists with ordinals."""
    asked = queries.select("query_id", F.col("query").alias("asked"), T.tokens(F.col("query")).alias("own_terms"))
    one = lambda x, name: x.groupBy("query_id", "file_id").agg(F.min_by("ordinal", "rank").alias(name))
    rows = results.join(small(asked), "query_id").join(files.select("file_id", "ocr_text"), "file_id")
    rows = rows.join(one(by_chunk, "kw_at"), ["query_id", "file_id"], "left").join(one(dense, "near_at"), ["query_id", "file_id"], "left")
    for name, at in (("kw_text", "kw_at"), ("near_text", "near_at")):
        rows = rows.join(chunks.select("file_id", F.col("ordinal").alias(at), F.col("text").alias(name)), ["file_id", at], "left")
    filled = lambda c: F.nullif(c, F.lit(""))
    image, keyword, none = F.col("kind") == "image", F.col("matched_via") != "semantic", F.lit(None).cast("string")
    pair = lambda text, source: F.when(text.isNotNull(), F.struct(text.alias("snippet"), F.lit(source).alias("snippet_source")))
    ocr, best = filled(T.marked(F.col("ocr_text"), F.col("own_terms"))), filled(T.marked(F.col("kw_text"), F.col("own_terms")))
    near = filled(T.snippet(F.col("near_text"), T.split_words(F.lower("asked"))))
    found = F.coalesce(
        pair(F.when(keyword & image, ocr).otherwise(none), "ocr"),
        pair(F.when(keyword, best).otherwise(none), "chunk"),
        pair(F.when(keyword & ~image, ocr).otherwise(none), "ocr"),
        pair(F.when(image, filled(F.substring("ocr_text", 1, 220))).otherwise(none), "ocr"),
        pair(near, "chunk"),
        F.struct(F.lit("").alias("snippet"), F.lit("name").alias("snippet_source")),
    )
    return rows.withColumn("found", found).select(*results.columns, "found.*")


def first_per_file(hits: DataFrame, score: str = "score") -> DataFrame:
    """A ranked list of chunks to one of files: each file's best chunk, ranks among files."""
    best = Window.partitionBy("query_id", "file_id").orderBy(F.desc(score), "ordinal")
    one = hits.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "file_id")))


def ranked_files(hits: DataFrame, score: str = "score") -> DataFrame:
    """As ``first_per_file`` for lists that aren't cut, of any length: no task holds all of a query's files."""
    best = Window.partitionBy("query_id", "file_id").orderBy(F.desc(score), "ordinal")
    one = hits.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r")
    return positions(one, ["query_id"], F.desc(score), F.asc("file_id"), name="__p").withColumn("rank", (F.col("__p") + 1).cast("int")).drop("__p")


def fuse(**lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, file_id, rank): the sum of
    1/(60 + rank), and of which retrievers a row came (``dense``: names starting with dense)."""
    parts = [df.select("query_id", "file_id", (1.0 / (RRF + F.col("rank"))).alias("share"), F.lit(name.startswith("dense")).alias("dense")) for name, df in sorted(lists.items())]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    both = F.max("dense") & F.max(~F.col("dense"))
    via = F.when(both, "both").when(F.max("dense"), "semantic").otherwise("keyword")
    return rows.groupBy("query_id", "file_id").agg(F.sum("share").alias("rrf"), via.alias("matched_via"))


def recency(mtime: Column, now: float) -> Column:
    """0.10 for a file of now, falling to 0 at thirty days."""
    age = (F.lit(now) - mtime) / 86400.0
    return F.when(age < 30, F.greatest(0.10 * (1 - age / 30.0), F.lit(0.0))).otherwise(0.0)


def penalties(kind: Column, mtime: Column, kinds: Column, date_from: Column, date_to: Column) -> Column:
    """0.05 for a row that isn't the image asked for, 0.05 for one outside the dates asked for."""
    image = F.array_contains(kinds, "image") & ~F.array_contains(kinds, "doc") & (kind != "image")
    outside = (F.coalesce(date_from, F.lit(0.0)) != 0) & (F.coalesce(date_to, F.lit(0.0)) != 0) & ~mtime.between(date_from, date_to)
    return F.when(image, 0.05).otherwise(0.0) + F.when(F.coalesce(outside, F.lit(False)), 0.05).otherwise(0.0)


def retrievers(queries: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 12, stems: bool = False, kept: tuple | None = None, near=None) -> dict[str, Callable[[], DataFrame]]:
    """The four ranked lists of a search, each as a function that makes it: chunks and files by keyword, text and
    image vectors by cosine. With ``kept``, the postings of chunks and of file names, no text is read;
    with ``near``, an index of the text vectors (``search`` as in ``ann``), not all of these are."""
    even = lambda hits: hits.withColumn("score", F.round("score", 9))  # noqa: E731  equal scores tie, whatever their last bits
    order = (F.desc("score"), F.asc("file_id"), F.asc("ordinal"))
    by_chunk = lambda: kept[0].bm25(queries, ["file_id", "ordinal"]) if kept else bm25(chunks, ["file_id", "ordinal"], "text", queries, stems)
    by_file = lambda: kept[1].bm25(queries, ["file_id"]) if kept else bm25(named(files), ["file_id"], "text", queries, stems)
    by_text = lambda: near.search(queries, 2 * k).drop("rank") if near else cosine(vectors.where("space = 'text'"), queries)
    return {
        "keyword_chunk": lambda: top_k(even(by_chunk()), 3 * k, *order),
        "keyword_file": lambda: top_k(even(by_file()), 3 * k, F.desc("score"), F.asc("file_id")),
        "dense_text": lambda: top_k(even(by_text()), 2 * k, *order),
        "dense_image": lambda: top_k(even(cosine(vectors.where("space = 'image'"), queries)), k, *order),
    }


def lists(queries: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 12, stems: bool = False, kept: tuple | None = None) -> dict[str, DataFrame]:
    """What the ``retrievers`` make."""
    return {name: make() for name, make in retrievers(queries, files, chunks, vectors, k, stems, kept).items()}


def named(files: DataFrame) -> DataFrame:
    """(file_id, ordinal, text) by which a file is found as a whole: its path and recognised text."""
    return files.select("file_id", F.lit(0).alias("ordinal"), F.concat_ws(" ", "path", "ocr_text").alias("text"))


def ranked(found: dict[str, DataFrame], queries: DataFrame, files: DataFrame, now: float, k: int = 12) -> DataFrame:
    """The lists fused, scored and cut: (query_id, file_id, path, kind, matched_via, rrf, score, rank)."""
    fused = fuse(**{name: first_per_file(x.drop("rank")) if "ordinal" in x.columns else x for name, x in found.items()})
    # the lists have 3k, 3k, 2k and k rows a query at most
    few = F.broadcast if queries.limit(BROADCAST_ROWS + 1).count() * 9 * k <= BROADCAST_ROWS else lambda x: x
    rows = files.join(few(fused), "file_id").join(few(queries.select("query_id", "kinds", "date_from", "date_to")), "query_id")
    penalty = penalties(F.col("kind"), F.col("mtime"), F.col("kinds"), F.col("date_from"), F.col("date_to"))
    # the small addend rounds exact halves up, whatever their last bit
    score = F.round(F.col("rrf") + 1e-9 + recency(F.col("mtime"), now) * 0.05 / 0.10 - penalty, 4)
    scored = rows.select("query_id", "file_id", "path", "kind", "matched_via", "rrf", score.alias("score"))
    return top_k(scored, k, F.desc("score"), F.desc(F.round("rrf", 9)), F.asc("file_id"))


def hybrid(queries: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, now: float, k: int = 12, kept: tuple | None = None) -> DataFrame:
    """The full search over ``queries`` (query_id, query, query_vec, kinds, date_from, date_to)."""
    return ranked(lists(queries, files, chunks, vectors, k, kept=kept), queries, files, now, k)


def search(queries: DataFrame, files: DataFrame, chunks: DataFrame, vectors: DataFrame, now: float, k: int = 12, stems: bool = True, kept: tuple | None = None, near=None, latency: str | None = None) -> DataFrame:
    """What a user asks: ``queries`` (query_id, query, query_vec) are rewritten, searched by their
    expanded text, and each result shows its scores and a snippet. Blank queries find nothing.

    Each list is worked out once; one whose retriever fails is empty. ``kept``: postings with the same
    ``stems``; ``near``: an index of the text vectors. With ``latency``, a folder, how long the lists took is
    one more row of its table."""
    spark, today = queries.sparkSession, F.to_date(F.timestamp_seconds(F.lit(now)))
    asked = rewritten(queries.where(F.trim("query") != "").withColumn("query", F.substring(F.trim("query"), 1, 200)), today)
    said = asked.withColumn("query", F.col("expanded"))
    makers = retrievers(said, files, chunks, vectors, k, stems, kept, near)
    of = f"query_id {queries.schema['query_id'].dataType.simpleString()}, file_id bigint"
    every = lambda: {name: or_nothing(make, f"{of}, score double, rank int" if name == "keyword_file" else f"{of}, ordinal int, score double, rank int", spark) for name, make in makers.items()}
    found = timed(every, spark, latency) if latency else every()
    out = ranked(found, asked, files, now, k)
    shown = best_of_lists(first_per_file(found["keyword_chunk"].drop("rank")), found["keyword_file"]).select("query_id", "file_id", F.col("shown").alias("match_keyword"))
    out = out.join(shown, ["query_id", "file_id"], "left")
    for name, source in (("match_semantic", "dense_text"), ("match_visual", "dense_image")):
        top = found[source].groupBy("query_id", "file_id").agg(F.round(F.max("score"), 3).alias(name))
        out = out.join(top, ["query_id", "file_id"], "left")
    out = out.fillna(0.0, ["match_keyword", "match_semantic", "match_visual"])
    return snippets(out, said, files, chunks, found["keyword_chunk"], found["dense_text"])
