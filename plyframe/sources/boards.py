"""Ranges of states, and boards written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.bits import bit, col


def rank_scan(spark: SparkSession, n: int) -> DataFrame:
    """(id) 0 .. n-1, in as many tasks as the session runs."""
    return spark.range(n)


def decode_ternary(df: DataFrame, id: str, n: int) -> DataFrame:
    """Masks a and b of a number with n base-3 digits, the first cell least significant: a
    has the cells with digit 1, b those with digit 2. Built-in arithmetic, no array."""
    a = b = F.lit(0).cast("long")
    for i in range(n):
        d = F.pmod(F.call_function("div", F.col(id), F.lit(3**i).cast("long")), F.lit(3))
        a = a + F.when(d == 1, F.lit(1 << i)).otherwise(0)
        b = b + F.when(d == 2, F.lit(1 << i)).otherwise(0)
    both = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    # explode keeps the masks from being computed again wherever they are used
    return df.select("*", F.explode(F.array(both)).alias("_m")).select("*", "_m.a", "_m.b").drop("_m")


def in_product(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df with i0, i1, ...: a number ``id`` as a member of a product of ranges, the last one
    least significant."""
    out, rest = df, F.col("id")
    for k, s in enumerate(reversed(sizes)):
        out = out.withColumn(f"i{len(sizes) - 1 - k}", F.pmod(rest, F.lit(s)))
        rest = F.call_function("div", rest, F.lit(s).cast("long"))
    return out.select(*df.columns, *[f"i{k}" for k in range(len(sizes))])


def product_space(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """(id, i0, i1, ...) of a product of ranges by arithmetic on one range, so the product
    is dealt out evenly and nothing is joined."""
    total = 1
    for s in sizes:
        total *= s
    return in_product(spark.range(total), sizes)


def subsets(spark: SparkSession, n: int, k: int) -> DataFrame:
    """(mask) of all k-subsets of n cells by their colex rank: a range of C(n, k) numbers,
    however large n is."""
    from math import comb

    from plyframe.functions.ranking import colex_unrank

    return spark.range(comb(n, k)).select(F.col("id").alias("rank"), colex_unrank("id", n, k).alias("mask"))


def mask_of(text: str | Column, chars: str) -> Column:
    """Mask of the places whose character is one of chars, separators taken out before."""
    marks = F.split(col(text), "")
    hits = F.transform(marks, lambda c, i: F.when(c.isin(list(chars)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def parse_rows(text: str | Column, sep: str = "/") -> Column:
    """The cells of a board written row by row, without the separators."""
    return F.replace(col(text), F.lit(sep), F.lit(""))


def parse_stacks(text: str | Column) -> DataFrame:
    """An array of the stacks of a row-by-row board whose cells are split by blanks."""
    return F.split(F.trim(col(text)), " +")


def moves_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, n, name) of the moves of a list such as "A1 C2 B3", in order."""
    return df.select(id, F.posexplode(F.split(F.trim(F.col(text)), "\\s+")).alias("n", "name"))


__all__ = ["bit", "decode_ternary", "in_product", "mask_of", "moves_of", "parse_rows", "parse_stacks", "product_space", "rank_scan", "subsets"]
