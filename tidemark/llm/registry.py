"""Queries of this subpackage: each applies one operator, with production parameters,
to its whole table and derives the columns that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bytepairs, decontaminate, divergence, htmlextract, langid, linededup, neighbours, packing, quality, runs, simhash, substring, urlfilter
from tidemark.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of op6: host and start of the path, to allow or to block.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_htmlextract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), declared_col="lang", host_col="source")
    return found.select("doc_id", "lang_id", "lang_score", "lang_accepted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op3"))
    return found.drop("text_hash")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op4"), tokenizer_path())


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document a page shows, whose id is the number in its address."""
    pages = table(spark, sf_dir, "pages")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("good"))
    shown = F.nullif(F.regexp_extract(urlfilter.path_of(F.col("url")), r"/([0-9]+)(?:[/.]|$)", 1), F.lit(""))
    found = urlfilter.judge(pages, labels, RULES, Scratch(spark, "op6"), key=shown)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.without_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op8"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), Scratch(spark, "op10"))


def op11_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bytepairs.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bytepairs.encode_texts(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    decoded = bytepairs.decode(F.col("ids"), vocabulary)
    return found.select("doc_id", bytepairs.count_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), seed=seed).withColumn("best", runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_htmlextract, op2_langid, op3_decontaminate, op4_packing, op5_linededup, op6_urlfilter, op7_simhash, op8_quality, op9_substring, op10_neighbours, op11_bytepairs, op12_runs, op13_divergence)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op12_runs": runs.ORACLE, "op13_divergence": divergence.ORACLE}
