"""Cutting lineage: written tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the folder that was given to setCheckpointDir; where
    neither is set, a folder of our own on one machine, as in tests, and an error on a
    cluster, whose executors share no local folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir("file:///tmp/plyframe-checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: rows of a stored table that one task reads, where its rows are counted
TASK_ROWS = 262_144


def stored(df: DataFrame, *folders: str) -> DataFrame:
    """Like cut(), as a compressed parquet table: for wide rows that are read in part, of some
    folders, if by columns that are given. It stays, as results read it, until clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    written(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: rows that a task takes in where rows are dealt out by their number
DEALT_ROWS = 1_048_576


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df, of so many rows at most, by the keys in as many partitions as they need, so the
    memory of a task that joins or adds them up does not grow with the table. Left to itself,
    Spark takes a fixed number of partitions. The same number of rows gives the same partitions."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS)), *keys)


#: tables of this run, with the application they belong to
_WRITTEN: list[tuple[str, str]] = []


def written(spark: SparkSession, path: str) -> None:
    """Note a folder of this application for clear()."""
    _WRITTEN.append((spark.sparkContext.applicationId, path))


def clear(spark: SparkSession) -> int:
    """Delete the tables that this application stored, when no result that reads them is
    needed any more. Gives how many there were."""
    mine = [x for x in _WRITTEN if x[0] == spark.sparkContext.applicationId]
    jvm = spark.sparkContext._jvm
    for x in mine:
        at = jvm.org.apache.hadoop.fs.Path(x[1])
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(x)
    return len(mine)
