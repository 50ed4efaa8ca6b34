"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star steps contract the graph until every node
points at the smallest node it can reach. Each step is a grouped minimum (combined
before the shuffle) and an equi-join, so a hub with many neighbours is split by
adaptive skew joins; no step gathers a node's neighbours in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

_names = iter(range(1 << 62))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a long, b long), in any direction, repeated or not, without nulls.
    Returns (node, root) for each node that isn't its component's smallest; a node
    without links is in no row. Loops are ignored. Tables of the last step stay in
    ``scratch``."""
    tag = f"components{next(_names)}"
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before, step = scratch.keep(now, f"{tag}-0"), None, 0
    while True:
        size, found, tangled = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count("*") - F.countDistinct("a")).first()
        if not size or (size, found) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if not tangled and not now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, step = (size, found), step + 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.keep(large, f"{tag}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), f"{tag}-{step}")
        scratch.drop(f"{tag}-large", f"{tag}-{step - 1}")
        now = after
