"""Seeded samples and playouts, the same on every run and cluster."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.ranking import binomials
from plyframe.games.core import Game
from plyframe.persist import cut
from plyframe.plans.journal import in_buckets


#: fixed values of the multiplicative generator modulo 2^31 - 1
MODULUS, MULTIPLIER = 2147483647, 48271


def sample_ids(df: DataFrame, id: str, one_in: int, seed: int = 0) -> DataFrame:
    """About one row in so many, by arithmetic on the id: any engine picks the same rows."""
    return df.where(F.pmod(F.col(id) * 48271 + seed * 16807, F.lit(2147483647)) % one_in == 0)


def scramble(ply: int, seed: int, walk: str = "game") -> Column:
    """Of a child ``dst``, the number by which one is picked: arithmetic on seed, walk, ply and
    the child, the same on any engine."""
    mixed = F.pmod(F.pmod("dst", F.lit(MODULUS)) * MULTIPLIER + F.col(walk) * 69621 + (ply * 16807 + seed * 40014), F.lit(MODULUS))
    return F.pmod(mixed * MULTIPLIER, F.lit(MODULUS))


def walks(edges: DataFrame, roots: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(walk, ply, id): walks along edges (src, dst) from roots (walk, id), each step to the
    child with the least scramble, ties to the least id; a walk without a child ends. A step
    is one join, and an aggregation in which a state with many children is picked from in
    parts first. Edges are in buckets of src."""
    now = cut(roots.select("walk", F.lit(0).alias("ply"), "id"))
    edges, out = cut(edges.select(F.col("src").alias("id"), "dst")), now
    edges = in_buckets(edges, "id", edges.count())
    for ply in range(1, steps + 1):
        pick = F.min_by("dst", F.struct(scramble(ply, seed, "walk"), "dst"))
        now = cut(now.join(edges, "id").groupBy("walk").agg(pick.alias("id")).select("walk", F.lit(ply).alias("ply"), "id"))
        out = out.unionByName(now)
    return out


def playouts(spark: SparkSession, game: Game, n: int, seed: int = 0, most: int = 10_000) -> DataFrame:
    """(game, ply, id): n games of moves picked by arithmetic on seed, game, ply and the
    child, the same on any engine: the child with the least scramble, ties to the least id. A
    game of more than ``most`` plies is an error."""
    now = cut(spark.range(n).select(F.col("id").alias("game"), F.lit(0).alias("ply"), F.lit(game.roots[0]).cast("long").alias("id")))
    out = now
    for ply in range(1, most + 1):
        going = game.decide(now.select("id").distinct()).where("value is null").select("id")
        moves = game.children(going)
        pick = F.min_by("dst", F.struct(scramble(ply, seed), "dst"))
        now = cut(now.join(moves, "id").groupBy("game").agg(pick.alias("id")).select("game", F.lit(ply).alias("ply"), "id"))
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise ValueError(f"a game of more than {most} plies")


def threshold(scores: DataFrame, score: str) -> Column:
    """The largest threshold that is reached: what a search by bisection would find."""
    return F.max(score)


def placements(n: int, pieces: list[int]) -> int:
    """States of a board of n cells with so many pieces of each kind."""
    out = 1
    for k in pieces:
        out *= comb(n, k)
        n -= k
    return out


def placement_counts(rows: DataFrame, n: int, pieces: list[str]) -> DataFrame:
    """rows with states: how many boards of n cells have as many pieces of each kind as the
    columns say, as exact decimals; 0 where there are more than cells. The coefficients are a
    table of the board's size."""
    c = F.broadcast(binomials(rows.sparkSession, n).select(F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("c").alias("_c")))
    out, left, states = rows, F.lit(n), F.lit(1).cast("decimal(38,0)")
    for k in pieces:
        out = out.withColumn("_left", left).join(c, (F.col("_n") == F.col("_left")) & (F.col("_k") == F.col(k)), "left")
        out = out.withColumn(f"_{k}", F.coalesce("_c", F.lit(0).cast("long"))).drop("_n", "_k", "_c", "_left")
        left, states = left - F.col(k), (states * F.col(f"_{k}")).cast("decimal(38,0)")
    return out.withColumn("states", states).drop(*(f"_{k}" for k in pieces))
