"""State and edge tables derived from ordinary tables, so the graph operators run at any
scale: a layered acyclic graph from the order lines, a cyclic one from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.persist import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, src, dst): orders (0) to parts (1) to suppliers (2) to nations (3); layer is
    that of src. Edges are distinct."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier")
    orders = lines.select(F.lit(0).alias("layer"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    parts = lines.select(F.lit(1).alias("layer"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return (
        dealt(orders.unionByName(parts), 2 * lines.count(), "src", "dst")
        .distinct()
        .unionByName(supplier.select(F.lit(2).alias("layer"), F.col("s_suppkey").alias("src"), F.col("s_nationkey").cast("long").alias("dst")))
    )


def supply_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value) of layer 3: a nation's value comes from its region modulo three."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.pmod("n_regionkey", F.lit(3)) - 1).cast("int").alias("value"))


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value): every event; purchases are lost for the side to move, others open."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", F.lit(-1)).alias("value"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): two arithmetic successors of each event that is no purchase, distinct."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.count("*").alias("n")).first().n
    open_ = events.where("event_type is null or event_type <> 'purchase'").select(F.col("event_id").alias("src"))
    k = F.explode(F.array(F.lit(1), F.lit(2)))
    step = open_.select("src", k.alias("k"))
    return step.select("src", F.pmod(7 * F.col("src") + F.col("k") * F.pmod("src", F.lit(11)) + F.col("k"), F.lit(max(n, 1))).alias("dst")).distinct()
