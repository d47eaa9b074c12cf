"""Zero-suppressed decision diagrams as four small arrays: ordered numbers for the members
of a family of sets, and back. A diagram is made on the driver from a family that fits there,
stored as a table, and sent to tasks behind a check of its size; families that are larger
are numbered by ``ranking.dense_ids`` instead."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: nodes of a diagram that is sent to every task at most
LARGEST = 5_000_000


@dataclass
class Zdd:
    """Node 0 is the empty family, node 1 the family of the empty set. A node's members
    without its element come first, so members are in order of their bits from element 0
    on, and ``count`` of lo is the number of them."""

    var: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    count: np.ndarray
    root: int

    @staticmethod
    def of(masks: Iterable[int], n: int) -> Zdd:
        var, lo, hi, count = [n, n], [0, 1], [0, 1], [0, 1]
        unique: dict[tuple[int, int, int], int] = {}
        # bottom up: families of suffixes, split off element by element
        level: dict[tuple[int, ...], None] = {tuple(sorted(set(masks))): None}
        chain = [level]
        for v in range(n):
            new: dict[tuple[int, ...], None] = {}
            for family in chain[-1]:
                new[tuple(m for m in family if not m >> v & 1)] = None
                new[tuple(m ^ 1 << v for m in family if m >> v & 1)] = None
            chain.append(new)
        node: dict[tuple[int, ...], int] = {f: 1 if f else 0 for f in chain[n]}
        for v in range(n - 1, -1, -1):
            above: dict[tuple[int, ...], int] = {}
            for family in chain[v]:
                a = node[tuple(m for m in family if not m >> v & 1)]
                b = node[tuple(m ^ 1 << v for m in family if m >> v & 1)]
                if b == 0:
                    above[family] = a
                    continue
                key = (v, a, b)
                if key not in unique:
                    unique[key] = len(var)
                    var.append(v)
                    lo.append(a)
                    hi.append(b)
                    count.append(count[a] + count[b])
                above[family] = unique[key]
            node = above
        return Zdd(np.array(var), np.array(lo), np.array(hi), np.array(count, dtype=np.int64), next(iter(node.values())))

    def __len__(self) -> int:
        return len(self.var) - 2

    def rank(self, mask: int) -> int | None:
        """Place of a member, None for others; elements between nodes must be absent."""
        at, out, seen = self.root, 0, 0
        while at > 1:
            v = int(self.var[at])
            if mask >> v & 1:
                out += int(self.count[self.lo[at]])
                seen |= 1 << v
                at = int(self.hi[at])
            else:
                at = int(self.lo[at])
        return out if at == 1 and seen == mask else None

    def unrank(self, k: int) -> int:
        if not 0 <= k < self.count[self.root]:
            raise IndexError(k)
        at, mask = self.root, 0
        while at > 1:
            without = int(self.count[self.lo[at]])
            if k < without:
                at = int(self.lo[at])
            else:
                k -= without
                mask |= 1 << int(self.var[at])
                at = int(self.hi[at])
        return mask

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, var, lo, hi, count, root): what is stored of it."""
        d = pd.DataFrame({"id": np.arange(len(self.var)), "var": self.var, "lo": self.lo, "hi": self.hi, "count": self.count, "root": np.arange(len(self.var)) == self.root})
        return spark.createDataFrame(d)

    @staticmethod
    def load(df: DataFrame) -> Zdd:
        n = df.count()
        if n > LARGEST:
            raise ValueError(f"a diagram of {n} nodes is too large to send; use dense_ids")
        d = df.toPandas().sort_values("id")
        return Zdd(*(d[c].to_numpy() for c in ("var", "lo", "hi", "count")), int(d["id"][d["root"]].iloc[0]))

    def _sent(self, spark: SparkSession):
        if len(self.var) > LARGEST:
            raise ValueError(f"a diagram of {len(self.var)} nodes is too large to send; use dense_ids")
        return spark.sparkContext.broadcast(self)

    def rank_column(self, spark: SparkSession, mask: str) -> Column:
        sent = self._sent(spark)

        @F.pandas_udf("long")
        def rank(masks: pd.Series) -> pd.Series:
            return pd.Series([sent.value.rank(int(m)) for m in masks], dtype="Int64")

        return rank(F.col(mask))

    def scan(self, spark: SparkSession) -> DataFrame:
        """(rank, mask) of every member, dealt out by rank."""
        sent = self._sent(spark)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                yield pd.DataFrame({"rank": d["id"], "mask": [sent.value.unrank(k) for k in d["id"].tolist()]})

        return spark.range(int(self.count[self.root])).mapInPandas(read, "rank long, mask long")
