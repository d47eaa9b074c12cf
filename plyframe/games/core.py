"""A game is a numbering of its states by one LONG and two dataflows over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.operators import folds
from plyframe.persist import cut
from plyframe.plans import fixpoint
from plyframe.plans.fixpoint import BESIDE


@dataclass(frozen=True)
class Game:
    """roots are state ids; children gives (id, dst), distinct, for states that go on;
    decide gives (id, value) with value null for those; stuck is the value of a state that
    goes on but has no move. acyclic games leave their layer with every move."""

    name: str
    roots: tuple[int, ...]
    children: Callable[[DataFrame], DataFrame]
    decide: Callable[[DataFrame], DataFrame]
    stuck: int
    acyclic: bool = False


def settle(df: DataFrame, **columns) -> DataFrame:
    """df with columns that are computed once, wherever they are used later."""
    return df.withColumn("_x", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(*df.columns, *[F.col(f"_x.{n}").alias(n) for n in columns])


def scripted(name: str, roots, moves: Callable[[int], list[int]], value: Callable[[int], int | None], stuck: int, acyclic: bool = False) -> Game:
    """A game whose rules do not fit built-in expressions (captures in sequence, links,
    walls that must leave a way): plain functions over Arrow batches."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            src, dst = [], []
            for s in d["id"].tolist():
                new = set(moves(s))
                src += [s] * len(new)
                dst += sorted(new)
            yield pd.DataFrame({"id": src, "dst": dst}, dtype="int64")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield pd.DataFrame({"id": d["id"], "value": pd.array([value(s) for s in d["id"].tolist()], dtype="Int32")})

    return Game(
        name, tuple(roots), lambda s: s.select("id").mapInPandas(expand, "id long, dst long"), lambda s: s.select("id").mapInPandas(judge, "id long, value int"), stuck, acyclic
    )


def plies(spark: SparkSession, game: Game, most: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """By ply, the new states (id, value, depth) and their moves (src, dst), all written. A
    ply is one expansion, one deduplication and, unless the game is acyclic, anti-joins
    against the states before."""
    front = spark.createDataFrame([(r,) for r in game.roots], "id long").distinct()
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    seen: list[DataFrame] = []  # all states so far, the last few plies beside the others
    while True:
        depth = len(nodes)
        # the number of the ply comes afterwards, so every ply runs the same generated code
        judged = cut(game.decide(front).select("id", F.col("value").cast("int")))
        if depth and judged.isEmpty():
            return nodes, edges
        nodes.append(judged.withColumn("depth", F.lit(depth)))
        if most is not None and depth >= most:
            return nodes, edges
        edges.append(cut(game.children(judged.where("value is null").select("id")).select(F.col("id").alias("src"), "dst").distinct()))
        front = edges[-1].select(F.col("dst").alias("id")).distinct()
        if not game.acyclic:
            seen.append(judged.select("id"))
            if len(seen) > BESIDE:
                seen = [cut(reduce(DataFrame.unionByName, seen))]
            for x in seen:
                front = front.join(x, "id", "left_anti")


def _all(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def explore(spark: SparkSession, game: Game, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, value, depth) of the states within so many plies of the roots, and (src, dst)
    of their moves."""
    nodes, edges = plies(spark, game, most)
    return _all(nodes, spark, "id long, value int, depth int"), _all(edges, spark, "src long, dst long")


def solve(spark: SparkSession, game: Game) -> DataFrame:
    """(id, value, decided_at) of every reachable state; value null is a draw by repetition.
    decided_at counts plies to the end for games whose ends are the states themselves."""
    nodes, edges = plies(spark, game)
    if not game.acyclic:
        states, moves = cut(_all(nodes, spark, "")), cut(_all(edges, spark, ""))
        on = moves.select(F.col("src").alias("id")).distinct().withColumn("goes", F.lit(True))
        ended = F.when(F.col("value").isNull() & F.col("goes").isNull(), game.stuck).otherwise(F.col("value"))
        return fixpoint.attractor(states.join(on, "id", "left").select("id", ended.alias("value")), moves)
    # one backward sweep: a state's children are one ply further on, so a ply reads its own
    # moves and the ply below only
    done: list[DataFrame] = []
    for ply in range(len(nodes) - 1, -1, -1):
        own = nodes[ply].select("id", "value")
        if done:
            up = folds.child_lookup(edges[ply], done[-1]).groupBy(F.col("src").alias("id")).agg(folds.negamax().cast("int").alias("v"))
            own = own.join(up, "id", "left").select("id", F.coalesce("value", "v", F.lit(game.stuck)).alias("value"))
        else:
            own = own.select("id", F.coalesce("value", F.lit(game.stuck)).alias("value"))
        done.append(cut(own))
    return _all(done, spark, "").withColumn("decided_at", F.lit(None).cast("int"))


def summary(spark: SparkSession, game: Game) -> DataFrame:
    """One row: states, wins, draws, losses, the first root's value, and its distance."""
    v = cut(solve(spark, game))
    root = v.where(F.col("id") == game.roots[0]).select(F.coalesce("value", F.lit(0)).alias("root_value"), F.col("decided_at").alias("root_plies"))
    counts = v.agg(
        F.count("*").alias("states"), F.count_if(F.col("value") == 1).alias("wins"), F.count_if(F.coalesce("value", F.lit(0)) == 0).alias("draws"), F.count_if(F.col("value") == -1).alias("losses")
    )
    return counts.join(root)


def replay(game: Game, log: DataFrame) -> DataFrame:
    """(game, ply, id, legal) of (game, ply, id): whether each state is the first root, at ply
    0, or one that a move leads to from the state before; a missing ply is not legal. One
    expansion of the distinct states and two joins, whatever the number of games."""
    moves = game.children(game.decide(log.select("id").distinct()).where("value is null").select("id")).select(F.col("id").alias("_src"), F.col("dst").alias("_dst")).distinct()
    before = log.select(F.col("game").alias("_g"), (F.col("ply") + 1).alias("_p"), F.col("id").alias("_from"))
    at = log.join(before, (F.col("game") == F.col("_g")) & (F.col("ply") == F.col("_p")), "left")
    at = at.join(moves.withColumn("_ok", F.lit(True)), (F.col("_from") == F.col("_src")) & (F.col("id") == F.col("_dst")), "left")
    legal = F.when(F.col("ply") == 0, F.col("id") == game.roots[0]).otherwise(F.coalesce("_ok", F.lit(False)))
    return at.select("game", "ply", "id", legal.alias("legal"))
