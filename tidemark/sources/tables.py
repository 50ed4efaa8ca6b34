"""Views of the engine's data model over parquet tables: files, chunks, vectors, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: The moment that reports and recency are computed for; always a parameter, never the clock.
NOW = 1735689600.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".txt", ".md", ".pdf", ".docx", ".png", ".zip", ".iso", ".html"])), (F.col("doc_id") % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["text", "text", "pdf", "docx", "image", "archive", "disk-image", "text"])), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"), F.col("source").alias("folder"), ext.alias("ext"),
        F.col("n_chars").alias("size_bytes"), (F.lit(NOW) - (F.col("doc_id") % 500) * 86400.0).alias("mtime"), kind.alias("kind"), F.when(kind == "image", F.substring("text", 1, 100)).otherwise("").alias("ocr_text"), (F.col("doc_id") % 16 == 4).alias("ocr_used"),
    )
    return docs


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), T.split_words(F.col("text")).alias("words"))
    return own.select("file_id", F.posexplode(T.chunks(F.col("words"))).alias("ordinal", "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / 4).alias("file_id"), (F.col("vec_id") % 4).cast("int").alias("ordinal"), F.when(F.col("label") % 2 == 0, "text").otherwise("image").alias("space"), F.col("embedding").cast("array<double>").alias("vec")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: errors stand for deletions, users for paths."""
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("changed")
    return read(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"))
