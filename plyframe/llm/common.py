"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.persist import cut, shared_dir, stored

__all__ = ["ByteWords", "LOWER", "components", "connected", "cut", "few", "mix64", "powers", "shared_dir", "stored", "table", "texts_together"]

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows of whole texts that go to Python together
TEXTS = 500


@contextmanager
def texts_together(spark: SparkSession) -> Iterator[None]:
    """While rows of whole texts are written through Python: batches of ``TEXTS`` rows, since
    a batch is held on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(TEXTS, int(before)) if int(before) > 0 else TEXTS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: rows, or cells of arrays, that are broadcast at most; more are joined by a shuffle
BROADCAST_ROWS = 1 << 17


def few(df: DataFrame, cells: str = "1") -> DataFrame:
    """df for the small side of a join: broadcast where the sum of ``cells``, how many values
    a row may hold, was computed and is at most ``BROADCAST_ROWS``. df should be written
    before, and hold numbers only."""
    total = df.agg(F.sum(F.expr(cells)).alias("n")).first().n or 0
    return F.broadcast(df) if total <= BROADCAST_ROWS else df


#: edges that one task joins up at most: 16 MB
FEW_EDGES = 1 << 20


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node
    of its component. Nulls are ignored. Edges that were counted and are few are joined up in
    one task. For more, large-star and small-star rounds alternate until the edges form stars;
    each round costs two aggregations and two joins over the edges, and the number of rounds
    grows with the logarithm of the longest chain.
    """
    e = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    if e.limit(FEW_EDGES + 1).count() <= FEW_EDGES:

        def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = list(batches)
            u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *(x.column(i).to_numpy() for x in whole)]) for i in range(2))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = connected(len(nodes), at[: len(u)], at[len(u) :])
            yield pa.RecordBatch.from_pydict({"node": nodes, "root": nodes[low]})

        return e.coalesce(1).mapInArrow(join_up, "node long, root long")

    def signature(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            e.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        e = cut(e)
        now = signature(e)
        if now == seen:
            break
        seen = now
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


#: odd, so it has an inverse modulo 2^64; fixed values of the rolling hash
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class ByteWords:
    """Word starts, ends and 64-bit hashes of a byte buffer, in whole-array steps.

    ``is_word`` is a table of 256 booleans. Hashes are of the word's bytes alone, so
    equal words have equal hashes wherever they stand; callers verify matches.
    """

    def __init__(self, data: bytes, is_word: np.ndarray):
        b = np.frombuffer(data, dtype=np.uint8)
        flag = np.empty(len(b) + 2, dtype=np.int8)
        flag[0] = flag[-1] = 0
        flag[1:-1] = is_word[b]
        step = np.flatnonzero(np.diff(flag))
        self.start, self.end = step[0::2], step[1::2]
        prefix = np.empty(len(b) + 1, dtype=np.uint64)
        prefix[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b)), dtype=np.uint64, out=prefix[1:])
        self.hash = (prefix[self.end] - prefix[self.start]) * powers(BASE_INV, len(b) + 1)[self.start]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
