"""Sets of states as bitmaps: 32,768 numbers a row, one bit each, by Spark's bitmap functions.
A frontier and the states seen are such tables, so a pass moves bits instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.plans.fixpoint import BESIDE, _after, _all
from plyframe.plans.journal import Journal

BITS = 32_768
#: rows of a frontier (4 KB each) that are broadcast at most; more are joined by a shuffle
FEW_MAPS = 2048


def maps_of(rows: DataFrame, column: str = "id") -> DataFrame:
    """(bucket, map) of the numbers in a column. Each task merges its own bits first, so a
    bucket is at most one row a task in the shuffle, however often a number comes."""
    number = F.col(column).cast("long")
    return rows.where(number.isNotNull()).groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("map"))


def merged(maps: DataFrame) -> DataFrame:
    """One row a bucket: the union of its maps."""
    return maps.groupBy("bucket").agg(F.bitmap_or_agg("map").alias("map"))


def _and_not(new: pd.Series, old: pd.Series) -> pd.Series:
    return pd.Series([a if b is None else (np.frombuffer(a, dtype=np.uint8) & ~np.frombuffer(b, dtype=np.uint8)).tobytes() for a, b in zip(new, old)], dtype=object)


def without(maps: DataFrame, old: DataFrame) -> DataFrame:
    """The maps, one row a bucket, less the bits of the old ones, one row a bucket too; empty
    ones are dropped. There is no built-in function for this on binary values, so these rows
    go through Arrow."""
    both = maps.join(old.select("bucket", F.col("map").alias("old")), "bucket", "left")
    return both.select("bucket", F.pandas_udf(_and_not, "binary")("map", "old").alias("map")).where(F.bitmap_count("map") > 0)


def has_bit(map_: str, place: str) -> Column:
    """Whether the bit at a place is set."""
    return F.expr(f"(shiftright(cast(conv(hex(substring({map_}, cast({place} div 8 as int) + 1, 1)), 16, 10) as int), cast({place} % 8 as int)) & 1) = 1")


def ids_of(maps: DataFrame) -> DataFrame:
    """The numbers of the maps as a column id, in place of bucket and map."""
    rest = [c for c in maps.columns if c not in ("bucket", "map")]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for k in range(len(d)):
                bucket = int(d["bucket"].iat[k])
                at = np.flatnonzero(np.unpackbits(np.frombuffer(d["map"].iat[k], dtype=np.uint8), bitorder="little"))
                out = {c: [d[c].iat[k]] * len(at) for c in rest}
                yield pd.DataFrame(out | {"id": (bucket - 1) * BITS + at + 1 if bucket > 0 else bucket * BITS - at})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in maps.schema if f.name in rest]
    return maps.mapInPandas(unpack, ", ".join([*fields, "id long"]))


def reach_maps(edges: DataFrame, roots: DataFrame, most: int | None = None, journal: Journal | None = None) -> DataFrame:
    """(depth, bucket, map): what the roots reach, with the least number of steps.

    The edges stay where they are written, as (bucket, place, dst), and are read once a pass;
    the frontier goes to them, by a broadcast while it has few buckets. The children become
    bits in the task that finds them. Which of them are new is an and-not with the union of
    the earlier frontiers, which goes into one table every few passes. Numbers may be negative;
    null ones are ignored. A journal that holds passes of the same run is taken up.
    """
    j = journal or Journal(edges.sparkSession)
    if not j.steps:
        src = F.col("src").cast("long")
        dealt = edges.where("src is not null and dst is not null").select(F.bitmap_bucket_number(src).alias("bucket"), F.bitmap_bit_position(src).alias("place"), F.col("dst").cast("long").alias("dst"))
        j.commit({"edges": dealt})
    e = j.read(j.steps[0], "edges")
    if len(j.steps) == 1:
        j.commit({"front": maps_of(roots)}, counts={"states": F.sum(F.bitmap_count("map"))}, depth=0)
    while True:
        last = [s for s in j.steps if "front" in s.tables][-1]
        depth, rows = last.notes["depth"], last.tables["front"].counts["rows"]
        if not rows or depth == most:
            break
        base, beside = _after(j, "seen")
        fronts = [j.read(s, "front") for s in (beside if base else j.steps) if "front" in s.tables]
        seen = merged(_all([*([j.read(base, "seen")] if base else []), *(f.select("bucket", "map") for f in fronts)]))
        if len(fronts) >= BESIDE:
            j.commit({"seen": seen})
            continue
        front = j.read(last, "front")
        front = F.broadcast(front) if rows <= FEW_MAPS else front
        children = maps_of(e.join(front, "bucket").where(has_bit("map", "place")).select("dst"), "dst")
        j.commit({"front": without(children, seen)}, counts={"states": F.sum(F.bitmap_count("map"))}, depth=depth + 1)
    return _all([j.read(s, "front").withColumn("depth", F.lit(s.notes["depth"])) for s in j.steps if "front" in s.tables]).select("depth", "bucket", "map")
