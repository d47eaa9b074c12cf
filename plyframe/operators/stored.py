"""Lookups in tables that were stored for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.persist import shared_dir, written


def bucketed_lookup(edges: DataFrame, values: DataFrame) -> DataFrame:
    """edges (src, dst) with the child's value, missing children dropped; both tables as from
    journal.in_buckets, edges by dst and values by id: neither is moved."""
    return edges.join(values.select(F.col("id").alias("dst"), "value"), "dst")


def in_layers(values: DataFrame) -> DataFrame:
    """values (layer, id, value) written to the shared folder, a folder for each layer, and
    read from there. persist.clear deletes it."""
    spark = values.sparkSession
    path = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    values.select("id", "value", "layer").write.partitionBy("layer").parquet(path)
    written(spark, path)
    return spark.read.schema("id long, value int, layer int").parquet(path)


def layer_lookup(edges: DataFrame, values: DataFrame, further: int = 1) -> DataFrame:
    """edges (layer, src, dst) with the child's value, missing children dropped. values are from
    in_layers, and children are ``further`` layers on. Which layers that is is in the edges' rows: the
    distinct ones, a row a layer, are broadcast first, and Spark reads only their folders.
    edges are read twice, so they should be written before. Layers are numbers from 0."""
    asked = edges.select((F.col("layer") + further).alias("layer"), "src", "dst")
    layers = asked.select("layer").distinct().where("layer >= 0")  # a filter is what makes Spark prune by a table
    there = values.join(F.broadcast(layers), "layer", "left_semi")
    return asked.join(there.select("layer", F.col("id").alias("dst"), "value"), ["layer", "dst"]).select((F.col("layer") - further).alias("layer"), "src", "dst", "value")
