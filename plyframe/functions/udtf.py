"""Moves as a table function, for SQL:

    register(spark, "moves_of", lambda n: [n // 2, n - 1])
    spark.sql("select s.id, m.dst from states s, lateral moves_of(s.id) m")

The dataflows of the engine expand whole batches instead; this is for looking around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession, name: str, moves: Callable[[int], list[int]]) -> None:
    class Moves:
        def eval(self, id: int):
            for dst in sorted(set(moves(id))):
                yield (dst,)

    spark.udtf.register(name, udtf(Moves, returnType="dst bigint"))
