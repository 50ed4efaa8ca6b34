"""Text lines of an image: bands of rows with ink, for readers that take one line at a time.

Native forms work on rows (image, y, ink); ``line_bands`` and ``pieces`` on one image's pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Pixels that differ so much from the median are ink; least ink of a row, rows of a
# band, ink of a piece; bands of an image and width of a piece at most; rows and pixels around.
INK, LEAST_INK, LEAST_ROWS, LEAST_PIECE, MOST_BANDS, MOST_WIDTH, ABOVE, AROUND = 60, 5, 10, 30, 24, 800, 5, 6


def bands(rows: DataFrame, image: str, y: str, ink: str) -> DataFrame:
    """(image, y0, y1): runs [y0, y1) of consecutive rows with more than LEAST_INK ink that are at
    least LEAST_ROWS long."""
    lit = rows.where(F.col(ink) > LEAST_INK).select(image, F.col(y).alias("y"))
    island = F.col("y") - F.row_number().over(Window.partitionBy(image).orderBy("y"))
    runs = lit.withColumn("island", island).groupBy(image, "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
    return runs.where(F.col("y1") - F.col("y0") >= LEAST_ROWS).drop("island")


def merged_runs(n: Column, most: int = MOST_BANDS) -> Column:
    """An array of struct(first, last), places from 0: n bands in at most ``most`` groups, each
    about as many."""
    one = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias("first"), i.alias("last")))
    step = n / F.lit(float(most))
    many = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.struct(F.floor(i * step).cast("int").alias("first"), F.least(n - 1, F.floor((i + 1) * step).cast("int") - 1).alias("last")))
    return F.when(n <= 0, F.array().cast("array<struct<first:int,last:int>>")).when(n > most, many).otherwise(one)


def line_bands(grey: np.ndarray) -> list[tuple[int, int]]:
    """The bands of one image, merged to MOST_BANDS at most."""
    ink = (np.abs(grey.astype(np.int16) - int(np.median(grey))) > INK).sum(axis=1) > LEAST_INK
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ink.astype(np.int8), [0]])))
    found = [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= LEAST_ROWS]
    if len(found) <= MOST_BANDS:
        return found
    step, out = len(found) / MOST_BANDS, []
    for i in range(MOST_BANDS):
        low, high = found[int(i * step)][0], found[min(len(found) - 1, int((i + 1) * step) - 1)][1]
        out.append((max(low, out[-1][1] + 1) if out else low, high))
    return out


def pieces(grey: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) to read one by one: each band trimmed to its ink, wide ones cut. An
    image without bands is one box; pieces with next to no ink are left out."""
    high, wide = grey.shape
    found = line_bands(grey)
    if not found:
        return [(0, 0, wide, high)]
    middle, out = int(np.median(grey)), []
    for a, b in found:
        top, low = max(0, a - ABOVE), min(high, b + ABOVE)
        ys, xs = np.nonzero(np.abs(grey[top:low].astype(np.int16) - middle) > INK)
        if len(ys) < LEAST_PIECE:
            continue
        x0, x1 = max(0, int(xs.min()) - AROUND), min(wide, int(xs.max()) + 1 + AROUND)
        y0, y1 = max(top, top + int(ys.min()) - AROUND), min(low, top + int(ys.max()) + 1 + AROUND)
        n = -(-(x1 - x0) // MOST_WIDTH)
        out += [(x0 + (x1 - x0) * i // n, y0, x0 + (x1 - x0) * (i + 1) // n, y1) for i in range(n)]
    return out


def dark(grey: np.ndarray) -> bool:
    """Light text on a dark ground, to be inverted before it is read."""
    return float(np.median(grey)) < 128
