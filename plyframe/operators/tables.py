"""Operators on whole tables: comparison, set operations, bounds, conflicts, products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.persist import cut
from plyframe.plans.journal import in_buckets


def table_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys on either side only, in both and equal, in both and different."""
    x = a.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(True).alias("in_a"))
    y = b.select(F.col(key).alias("k"), F.col(value).alias("y"), F.lit(True).alias("in_b"))
    j = x.join(y, "k", "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.col("x").eqNullSafe(F.col("y"))
    return j.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.count_if(both & same).alias("equal"), F.count_if(both & ~same).alias("different")
    )


def multiset_equal(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merge_bounds(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Intersection of two tables of intervals (key, lower, upper); consistent is false
    where they do not meet. A key on one side keeps that interval."""
    x = a.select(key, F.col("lower").alias("l1"), F.col("upper").alias("u1"))
    y = b.select(key, F.col("lower").alias("l2"), F.col("upper").alias("u2"))
    j = x.join(y, key, "full")
    out = j.select(key, F.greatest("l1", "l2").alias("lower"), F.least("u1", "u2").alias("upper"))
    return out.withColumn("consistent", F.col("lower") <= F.col("upper"))


def compare_golden(values: DataFrame, golden: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, ok) for every golden row; golden tables are short."""
    return golden.join(values, key, "left").withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def conflict_pairs(items: DataFrame, id: str, conflict, within: str | None = None) -> DataFrame:
    """(a, b), a < b, of items for which conflict(left, right) holds. With ``within`` only items
    that have it in common meet, by an equi-join, and it is a column of the result: what
    grows is the groups, which should be small. Without, for the small tables of a board's
    geometry: the join is by an inequality."""
    x, y = items.alias("x"), items.alias("y")
    left = lambda c: F.col(f"x.{c}")
    right = lambda c: F.col(f"y.{c}")
    both = (left(id) < right(id)) & conflict(left, right)
    if within is not None:
        both = (left(within) == right(within)) & both
    return x.join(y, both).select(*([left(within).alias(within)] if within else []), left(id).alias("a"), right(id).alias("b"))


def independent_sets_within(items: DataFrame, conflicts: DataFrame, group: str, most: int) -> DataFrame:
    """(group, k, members) of all sets of up to ``most`` items of a group that do not conflict:
    items (group, id), conflicts (group, a, b), members ids in rising order. A step adds to
    each set the later items of its group that conflict with none in it. Every group has the
    empty set."""
    ways = conflicts.select(group, "a", F.col("b").alias("o")).unionByName(conflicts.select(group, F.col("b").alias("a"), F.col("a").alias("o")))
    shut = ways.groupBy(group, F.col("a").alias("id")).agg(F.collect_set("o").alias("shut"))  # at most a group's items
    own = cut(items.select(group, "id").distinct().join(shut, [group, "id"], "left"))
    own = in_buckets(own, group, own.count())
    kind = dict(own.dtypes)["id"]
    now = own.select(group).distinct().select(group, F.lit(0).alias("k"), F.array().cast(f"array<{kind}>").alias("members"))
    out = now
    for k in range(1, most + 1):
        free = (F.size("members") == 0) | (F.try_element_at("members", F.lit(-1)) < F.col("id"))
        now = now.join(own, group).where(free & ~F.coalesce(F.arrays_overlap("members", "shut"), F.lit(False)))
        now = cut(now.select(group, F.lit(k).alias("k"), F.array_append("members", F.col("id")).alias("members")))
        out = out.unionByName(now)
    return out


def independent_sets(items: DataFrame, conflicts: DataFrame, most: int) -> DataFrame:
    """(k, members mask) of all sets of up to ``most`` items without a conflict, items
    numbered below 63. Sets grow by their largest item, so each is made once."""
    pow2 = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").cast("int"))
    near = items.select("id").join(
        conflicts.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(conflicts.select(F.col("b").alias("id"), F.col("a").alias("o"))), "id", "left"
    )
    bit_o = F.when(F.col("o").isNull(), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o").cast("int")))
    shut = near.groupBy("id").agg(F.bit_or(bit_o).alias("shut")).withColumn("bit", pow2)
    now = items.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("members"), F.lit(-1).cast("long").alias("last"))
    out = now
    for k in range(1, most + 1):
        now = now.join(F.broadcast(shut), (F.col("id") > F.col("last")) & (F.col("members").bitwiseAND(F.col("shut")) == 0)).select(
            F.lit(k).alias("k"), F.col("members").bitwiseOR(F.col("bit")).alias("members"), F.col("id").cast("long").alias("last")
        )
        now = cut(now)  # else every size is made again from the empty set
        out = out.unionByName(now)
    return out.select("k", "members")


def union_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def new_rows(a: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Insert-if-absent: distinct rows of a whose key is not in seen."""
    return a.dropDuplicates(key).join(seen.select(*key), key, "left_anti")


def merge_bits(parts: DataFrame, by: str, bits: str) -> DataFrame:
    return parts.groupBy(by).agg(F.bit_or(bits).alias(bits))


def bitmap_count(rows: DataFrame, key: str | Column) -> DataFrame:
    """Number of distinct non-negative keys, through bitmaps of 32,768 keys each."""
    k = F.col(key) + 1 if isinstance(key, str) else key + 1
    maps = rows.select(F.expr("1"), k.alias("k")).groupBy(F.call_function("bitmap_bucket_number", F.col("k")).alias("bucket")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("k"))).alias("m")
    )
    return maps.agg(F.sum(F.call_function("bitmap_count", F.col("m"))).alias("distinct_keys"))
