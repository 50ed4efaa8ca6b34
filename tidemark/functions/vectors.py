"""Column functions over array<double> vectors, the hashing encoder and quantisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import words

HASH_DIMENSIONS = 768


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))


def quantise(a: Column) -> tuple[Column, Column]:
    """Bytes of round-half-even(x / scale * 127), and scale, the greatest magnitude (1 for zero)."""
    top = F.array_max(F.transform(a, F.abs))
    scale = F.when(top > 0, top).otherwise(1.0)
    return F.transform(a, lambda x: F.bround(x / scale * 127).cast("int")), scale


def dequantised(quant: Column, scale: Column) -> Column:
    """Bytes of ``quantise`` as numbers again."""
    return F.transform(quant, lambda x: x * scale / 127.0)


def padded(ids: Column, length: Column | int, fill: int = 0) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(length - F.size(ids), F.lit(0))))


def grams(own: Column) -> Column:
    """All runs of one, two and three words."""

    def run(n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1)))
        return F.when(F.size(own) >= n, F.transform(at, lambda i: F.array_join(F.slice(own, i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = [own, run(2), run(3)]
    return F.concat(*runs)


def hashed_features(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sparse hashing encoder: (id, bucket, weight), normalised to length one.

    A gram's hash is the little-endian number of the first eight bytes of its MD5, its
    bucket that number modulo 768, which is (b0 + 256 ((b1 + ... + b7) mod 3)) mod 768; its sign the
    lowest bit of b1."""
    own = rows.select(id_col, words(F.col(text_col)).alias("words"))
    # each word with the two after it, so that grams are made by generated code; a gram becomes two numbers before anything is shuffled
    runs = own.select(id_col, F.inline(F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"), F.slice("words", 3, F.size("words")).alias("c"))))
    two = F.concat("a", F.lit(" "), "b")
    each = runs.select(id_col, F.explode(F.array("a", two, F.concat(two, F.lit(" "), "c"))).alias("gram")).where("gram is not null").select(id_col, F.md5("gram").alias("md5"))
    # 256 is 1 modulo 3: the sum of bytes is, modulo 3, the number that they are the digits of
    first, rest = (F.conv(F.substring("md5", at, n), 16, 10).cast("bigint") for at, n in ((1, 2), (3, 14)))
    bucket = ((first + 256 * (rest % 3)) % HASH_DIMENSIONS).cast("int")
    sign = F.when(F.shiftright(rest, 48) % 2 == 1, 1).otherwise(-1)
    sums = each.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).alias("w")).where("w != 0")
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)).cast("double"))  # HASH_DIMENSIONS rows an id at most
    return sums.select(id_col, "bucket", (F.col("w") / size).alias("weight"))
