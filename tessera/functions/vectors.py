"""Vector functions: quantisation, products, and the default encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .text import each, terms


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once; inside a lambda an expression would be for each element."""
    return F.get(F.transform(F.array(value), f), 0)


def scale(v: Column) -> Column:
    """The largest magnitude, or 1 for a zero vector."""
    top = F.array_max(F.transform(doubles(v), F.abs))
    return F.when(top > 0, top).otherwise(F.lit(1.0))


def quantise(v: Column) -> Column:
    """struct(q array<tinyint>, scale): 127 stands for the largest magnitude; halves go to the even number."""
    bytes_ = lambda d, s: F.struct(F.transform(d, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / s * 127))).cast("tinyint")).alias("q"), s.alias("scale"))
    return once(doubles(v), lambda d: once(scale(d), lambda s: bytes_(d, s)))


def dequantise(q: Column, s: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * (s / 127))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    return once(doubles(v), lambda d: once(F.sqrt(dot(d, d)), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)))


def hashed_encoder(df: DataFrame, key: str, text: str, dims: int = fixed.DIMS) -> DataFrame:
    """(key, vector): an offline encoder. A term adds 1 or -1 at the dimension of its hash; lengths are 1."""
    h = F.xxhash64("term")
    one = each(df, [key], terms(F.col(text)), "term").select(key, F.pmod(h, F.lit(dims)).cast("int").alias("d"), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("w"))
    sums = one.groupBy(key, "d").agg(F.sum("w").alias("w")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("d", "w"))).alias("m"))  # dims entries at most
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)))
    return sums.select(key, normalise(dense).alias("vector"))
