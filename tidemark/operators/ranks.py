"""Positions in the order of groups of any size, without a task that holds a group.

Rows are dealt by ranges of (group, order), so a large group is many partitions. Each row's place in
its partition and the sizes of the partitions before, a few numbers for each group, give its
position. A frame of rows before each row is taken in blocks of positions, each with the rows before it
that its first rows look back to.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import shared_folder

#: Positions of a group in one block.
BLOCK = 1 << 16


def positions(rows: DataFrame, group: list[str], *order: Column, name: str = "position", parts: int | None = None) -> DataFrame:
    """``rows`` with their position from 0 in their group, in ``order``; equal rows in any order. Null groups
    are groups like others; an empty table stays empty."""
    spark = rows.sparkSession
    keys = [F.col(g) for g in group]
    dealt = rows.repartitionByRange(parts, *keys, *order) if parts else rows.repartitionByRange(*keys, *order)
    # a number of a partition and a place in it, written with the row so that both stay what they are
    placed = dealt.sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    at = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    placed.write.parquet(at)
    held = spark.read.schema(placed.schema).parquet(at).withColumn("__part", F.shiftright("__at", 33))
    sizes = held.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sizes.select(*group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    other = starts.withColumnsRenamed({g: f"__{g}" for g in group} | {"__part": "__p"})
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.col("__part") == F.col("__p"))
    met = held.join(other, same)
    return met.select(*rows.columns, (F.col("__at") + F.col("__start")).alias(name))


def frames(rows: DataFrame, group: list[str], position: str, before: int, block: int = BLOCK, **made) -> DataFrame:
    """``rows`` with a column for each of ``made``: a function of the window of a row and the ``before`` rows before it
    in its group, by ``position``."""
    block = max(block, before)
    own = F.floor(F.col(position) / block)
    # a row goes to its block, and to the next one if that looks back to it
    blocks = F.when(F.col(position) % block >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("__block", F.explode(blocks))
    window = Window.partitionBy(*group, "__block").orderBy(position).rowsBetween(-before, 0)
    found = dealt.withColumns({name: f(window) for name, f in made.items()})
    return found.where(F.col("__block") == own).drop("__block")
