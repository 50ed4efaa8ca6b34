"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; what it returns
is written as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, linededup, packing, simhash
from tidemark.llm.registry import table, tokenizer_path
from tidemark.llm.scratch import Scratch, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def python_scratch(spark: SparkSession, name: str) -> Scratch:
    """For a stage of Python workers: the heap that the stages before took is theirs."""
    scratch = Scratch(spark, name)
    scratch.shrink()
    return scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found go on; those without letters, or whose best
    language stays under the least posterior, go. Declared languages are kept as they are."""
    return langid.identify(docs, declared_col="lang", host_col="source").where("lang_accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat go; documents of which no line is left go; ``n_chars`` follows the text."""
    found = linededup.dedup_lines(docs, Scratch(spark, "pipeline-lines")).where("n_removed = 0 or n_removed < n_lines")
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (exact Jaccard similarity of their sets
    of five words at least 0.8) stays: the one with the least id."""
    return simhash.keep_one(docs, python_scratch(spark, "pipeline-simhash"), width=5, similarity=0.8).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), python_scratch(spark, "pipeline-leaks")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, python_scratch(spark, "pipeline-packing"), tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express tokenising and MinHash; tests compare each stage with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs, root = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
