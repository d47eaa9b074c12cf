"""Values of asked states only, in a graph of which the rest is not looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.plans.fixpoint import _all, attractor
from plyframe.plans.journal import Journal, in_buckets


def evaluate(asked: DataFrame, nodes: DataFrame, edges: DataFrame, journal: Journal | None = None) -> tuple[DataFrame, int]:
    """(id, value, decided_at) of the asked states, as fixpoint.attractor gives it for all, and
    how many states were met. asked has a column id; nodes are (id, value), value null where
    open; edges (src, dst) are distinct. Asked states that are no nodes have no row.

    From the asked states a pass goes one step down: their edges are found by a join with the
    stored ones, which stay in place, and the children's values by another. A state that has a
    child lost at once is won, so its other children are not met: it leaves with the edges to
    the lost ones. Those that were met and are open are the next frontier. The passes of the
    attractor then run over what was met. A journal that holds passes of the same run is
    taken up.
    """
    j = journal or Journal(edges.sparkSession)
    of = in_buckets(nodes.select("id", F.col("value").cast("int").alias("value")), "id")
    e = in_buckets(edges.select(F.col("src").alias("id"), "dst"), "id")
    open_ = {"open": F.count_if(F.col("value").isNull())}
    if not j.steps:
        j.commit({"met": asked.select("id").distinct().join(of, "id")}, counts=open_)
    while True:
        last = j.steps[-1]
        if "met" in last.tables:
            if not last.tables["met"].counts["open"]:
                break
            front = j.read(last, "met").where("value is null").select("id")
            below = front.join(e, "id").select(F.col("id").alias("src"), F.col("dst").alias("id")).join(of, "id", "left")
            below = below.select("src", F.col("id").alias("dst"), "value")
            won = below.where("value = -1").select("src").distinct().withColumn("won", F.lit(True))
            j.commit({"kept": below.join(won, "src", "left").where("won is null or value = -1").select("src", "dst", "value")})
            continue
        met = _all([j.read(s, "met").select("id") for s in j.steps if "met" in s.tables])
        new = j.read(last, "kept").select(F.col("dst").alias("id")).distinct().join(met, "id", "left_anti").join(of, "id")
        j.commit({"met": new}, counts=open_)
    met = [s for s in j.steps if "met" in s.tables]
    kept = [j.read(s, "kept").select("src", "dst") for s in j.steps if "kept" in s.tables]
    moves = _all(kept) if kept else edges.select("src", "dst").limit(0)
    solved = attractor(_all([j.read(s, "met") for s in met]), moves)
    return solved.join(j.read(met[0], "met").select("id"), "id", "left_semi"), sum(s.tables["met"].counts["rows"] for s in met)
