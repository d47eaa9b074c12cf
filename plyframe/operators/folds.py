"""Aggregations over the children of a state, and tallies. Values are -1 loss, 0 draw,
1 win, null undecided, always from the view of the side to move. All are built-in
aggregates, so they combine partially before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyframe.persist import cut

#: stands for infinity in proof and disproof numbers
PN_INF = 1_000_000_000


def negamax(value: str = "value") -> Column:
    """Value of the parent when every child is decided: the best of the negated values."""
    return F.max(-F.col(value))


def and_or(value: str = "value") -> Column:
    """Parent value while children may be undecided (null): 1 if any child is lost, -1 if
    all are won, 0 if all are decided and none is lost, else null."""
    v = F.col(value)
    return F.when(F.bool_or(F.coalesce(v == -1, F.lit(False))), 1).when(F.bool_or(v.isNull()), None).when(F.bool_and(v == 1), -1).otherwise(0)


def child_lookup(edges: DataFrame, values: DataFrame, missing: str = "drop") -> DataFrame:
    """edges (src, dst) with the child's value. A child that is not in values is dropped
    ("drop"), counts as drawn ("draw", with a column that tells: defaulted), or ends the query
    ("fail")."""
    v = values.select(F.col("id").alias("dst"), "value")
    if missing == "drop":
        return edges.join(v, "dst")
    out = edges.join(v.withColumn("_there", F.lit(True)), "dst", "left")
    if missing == "draw":
        return out.withColumn("value", F.when(F.col("_there"), F.col("value")).otherwise(0)).withColumn("defaulted", F.col("_there").isNull()).drop("_there")
    wrong = F.raise_error(F.concat(F.lit("no value for child "), F.col("dst").cast("string")))
    return out.withColumn("value", F.when(F.col("_there"), F.col("value")).otherwise(wrong.cast("int"))).drop("_there")


def parents(edges: DataFrame, values: DataFrame, missing: str = "drop") -> DataFrame:
    """(id, value) of every src with children."""
    return child_lookup(edges, values, missing).groupBy(F.col("src").alias("id")).agg(and_or().cast("int").alias("value"))


def out_degrees(edges: DataFrame) -> DataFrame:
    """(id, outdeg, n_children): edges and distinct children of each src."""
    one = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    return one.groupBy(F.col("src").alias("id")).agg(F.sum("k").alias("outdeg"), F.count("*").alias("n_children"))


def winners_by_semi_join(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id): states with a lost child, each once, without an aggregation over children."""
    lost = values.where("value = -1").select(F.col("id").alias("dst"))
    return edges.join(lost, "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def stuck(states: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): states without a move."""
    return states.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def proof_numbers(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, pn, dn) of parents from children (id, pn, dn): pn is the least child dn, dn the
    sum of child pn, both at most PN_INF."""
    c = edges.join(numbers.select(F.col("id").alias("dst"), "pn", "dn"), "dst")
    return c.groupBy(F.col("src").alias("id")).agg(
        F.least(F.min("dn"), F.lit(PN_INF)).cast("long").alias("pn"), F.least(F.sum("pn"), F.lit(PN_INF)).cast("long").alias("dn")
    )


def tally(values: DataFrame, by: str = "layer") -> DataFrame:
    """Wins, draws, losses, open states by ``by``, and a total row where it is null."""
    count = lambda c: F.count_if(c).alias
    return values.rollup(by).agg(
        count(F.col("value") == 1)("wins"), count(F.col("value") == 0)("draws"), count(F.col("value") == -1)("losses"), count(F.col("value").isNull())("open")
    )


def weighted_tally(values: DataFrame, weight: str = "weight") -> DataFrame:
    return values.groupBy("value").agg(F.count("*").alias("states"), F.sum(weight).alias("weighted"))


def depth_by_value(values: DataFrame) -> DataFrame:
    return values.where("value is not null").groupBy("value").agg(F.max("decided_at").alias("max_depth"), F.count("*").alias("states"))


def pass_history(values: DataFrame) -> DataFrame:
    """How many wins and losses each pass decided."""
    return values.where("decided_at is not null").groupBy("decided_at").agg(F.count_if(F.col("value") == 1).alias("new_wins"), F.count_if(F.col("value") == -1).alias("new_losses"))


def multiplicity(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows, distinct keys, and rows per key."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys")).withColumn("ratio", F.round(F.col("rows") / F.col("distinct_keys"), 6))


def prefix_base(rows: DataFrame, order: str, size: str) -> DataFrame:
    """rows with base, the sum of size over smaller ``order``: offsets of blocks in one
    table. For a table of blocks, which is small; dense_ids numbers the rows themselves."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum(size).over(before), F.lit(0)))


def bucket_sample(rows: DataFrame, bucket: str, key: Column, n: int) -> DataFrame:
    """The first n rows of each bucket in the order of key, ties by every column. Spark
    limits each task's share of a bucket before the shuffle."""
    w = Window.partitionBy(bucket).orderBy(key, *rows.columns)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_move(moves: DataFrame, by: str, score: str, move: str) -> DataFrame:
    """The move with the best score, ties to the smallest move."""
    top = F.max_by(F.struct(F.col(score).alias("score"), F.col(move).alias("move")), F.struct(F.col(score), -F.col(move)))
    return moves.groupBy(by).agg(top.alias("t")).select(by, "t.score", "t.move")


def ordered_moves(moves: DataFrame, by: str, score: str, move: str) -> DataFrame:
    """moves with their place among those of the same state: best score first, ties by the
    smallest move. For display; folds need no order."""
    w = Window.partitionBy(by).orderBy(F.desc(score), move)
    return moves.withColumn("place", F.row_number().over(w))


def count_paths(edges: DataFrame, roots: DataFrame, plies: int) -> DataFrame:
    """(ply, id, paths): walks of each length from the roots, with multiplicity."""
    edges = cut(edges.select("src", "dst"))
    now = roots.select(F.lit(0).alias("ply"), "id", F.lit(1).cast("decimal(38,0)").alias("paths"))
    out = now
    for ply in range(1, plies + 1):
        now = (
            now.join(edges.select(F.col("src").alias("id"), "dst"), "id")
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
            .select(F.lit(ply).alias("ply"), "id", "paths")
        )
        now = cut(now)  # else every ply is counted again from the roots
        out = out.unionByName(now)
    return out
