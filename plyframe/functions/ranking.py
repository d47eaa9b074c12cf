"""Dense numbers for combinatorial families, and back."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.functions.bits import bit, col


def binomials(spark: SparkSession, n: int) -> DataFrame:
    """(n, k, c): Pascal's triangle up to n <= 60, from the product formula."""
    rows = spark.range(0, n + 1).select(F.col("id").cast("int").alias("n"))
    rows = rows.select("n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    step = F.when(F.col("k") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("k")))
    c = F.aggregate(step, F.lit(1).cast("decimal(38,0)"), lambda a, i: F.call_function("div", a * (F.col("n") - F.col("k") + i), i).cast("decimal(38,0)"))
    return rows.select("n", "k", c.cast("long").alias("c"))


def _choose(n: Column, table: list[list[int]], k: int) -> Column:
    return F.get(F.array(*[F.lit(r[k]).cast("long") for r in table]), n)


def colex_rank(cells: str | Column, n: int, k: int) -> Column:
    """Rank of an ascending array of k cells below n among all k-subsets in colex order:
    the sum of C(cell, position + 1)."""
    table = [[comb(c, j) for j in range(k + 1)] for c in range(n + 1)]
    flat = F.array(*[F.lit(table[c][j]).cast("long") for c in range(n + 1) for j in range(k + 1)])
    pairs = F.transform(col(cells), lambda c, i: F.get(flat, c.cast("int") * (k + 1) + i + 1))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)


def colex_unrank(rank: str | Column, n: int, k: int) -> Column:
    """The mask of the k-subset of n cells with that rank: cells from the top, each the
    largest whose binomial still fits."""
    state = F.struct(col(rank).cast("long").alias("r"), F.lit(k).alias("k"), F.lit(0).cast("long").alias("m"))
    flat = F.array(*[F.lit(comb(c, j)).cast("long") for c in range(n + 1) for j in range(k + 1)])

    def step(s: Column, c: Column) -> Column:
        need = F.get(flat, c * (k + 1) + s["k"])
        take = (s["k"] > 0) & (need <= s["r"])
        return F.struct(
            F.when(take, s["r"] - need).otherwise(s["r"]).alias("r"),
            F.when(take, s["k"] - 1).otherwise(s["k"]).alias("k"),
            F.when(take, s["m"].bitwiseOR(bit(c))).otherwise(s["m"]).alias("m"),
        )

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), state, step, lambda s: s["m"])


def subset_rank_lex(cells: str | Column, n: int, k: int) -> Column:
    """Rank of an ascending array of k cells below n among all k-subsets in lexicographic
    order: those that come before have a smaller cell at the first place that differs."""
    flat = F.array(*[F.lit(comb(c, j)).cast("long") for c in range(n + 1) for j in range(k + 1)])
    # mirrored, the lexicographic order is the colex order from its end
    after = F.transform(F.reverse(col(cells)), lambda c, i: F.get(flat, (n - 1 - c.cast("int")) * (k + 1) + i + 1))
    return F.lit(comb(n, k) - 1).cast("long") - F.aggregate(after, F.lit(0).cast("long"), lambda a, x: a + x)


def restricted_rank(cells: str | Column, block: str | Column, n: int, k: int) -> Column:
    """Colex rank among the subsets of the cells outside block."""
    free = F.transform(col(cells), lambda c: (c - F.bit_count(col(block).bitwiseAND(bit(c) - 1))).cast("int"))
    return colex_rank(free, n, k)


def mixed_radix(digits: list[Column], bases: list[int]) -> Column:
    """One number of digits below their bases, the first the most significant."""
    out = F.lit(0).cast("long")
    for d, b in zip(digits, bases):
        out = out * b + d
    return out


def dense_ids(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Numbers 0, 1, ... in the order of keys, without one task that holds all rows: range
    partitions are numbered inside, and a prefix sum of their sizes (one row a partition)
    is added. Equal rows get different numbers in any order."""
    spread = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    spread = spread.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1)
    from plyframe.persist import stored

    spread = stored(spread)
    sizes = spread.groupBy("_part").agg(F.count("*").alias("n"))
    base = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return spread.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def selection_ids(df: DataFrame, member: Column, keys: list[str], name: str = "id") -> DataFrame:
    """df with numbers 0, 1, ... in the order of keys for the rows that are members, null for
    others; keys are unique."""
    ids = dense_ids(df.where(member).select(*keys), keys, name)
    return df.join(ids, keys, "left")
