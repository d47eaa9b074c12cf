"""A backward sweep in parts: each pass probes the children's values of one part only, and
its partial counts are kept, so the values that a task looks up are a part of a layer, and a
run that is broken off goes on with the parts that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.persist import dealt
from plyframe.plans.fixpoint import _all, _rows, valued
from plyframe.plans.journal import Journal, Step

#: children of a parent by their values, each from the side that moves there
COUNTS = {"lost": -1, "drawn": 0, "won": 1}


def part_of(column: str, parts: int) -> Column:
    return F.expr(f"int(pmod(xxhash64({column}), {parts}))")


def folded() -> Column:
    """A parent's value from the counts of its children: won if a child is lost, else drawn if
    one is drawn, else lost."""
    return F.when(F.col("lost") > 0, 1).when(F.col("drawn") > 0, 0).when(F.col("won") > 0, -1)


def _with(journal: Journal, table: str, **notes) -> list[Step]:
    return [s for s in journal.steps if table in s.tables and all(s.notes.get(k) == v for k, v in notes.items())]


def sweep_in_parts(edges: DataFrame, leaves: DataFrame, deepest: int, parts: int = 8, journal: Journal | None = None) -> DataFrame:
    """(layer, id, value) of a layered acyclic graph, as fixpoint.sweep gives it with the fold
    over lost, drawn and won children. edges (layer, src, dst) lead from a layer to the next;
    leaves (id, value) make up layer ``deepest``.

    Edges are written once, in folders by layer and by the part of their child; a layer's
    values by part. A step joins the edges of one layer and part with the values of that
    part, and writes for each parent how many of these children are lost, drawn and won. When
    a layer has all its parts their sums give the parents' values. Undecided children count
    for nothing; parents without a decided child have no row. Rows are dealt out by their
    number, which the journal or the files of the edges tell.
    """
    j = journal or Journal(edges.sparkSession)
    if not j.steps:
        j.commit({"edges": edges.select("src", "dst", "layer", part_of("dst", parts).alias("part"))}, folders={"edges": ["layer", "part"]})
    e = j.read(_with(j, "edges")[0], "edges")
    sizes = {(r.layer, r.part): r.n for r in e.groupBy("layer", "part").agg(F.count("*").alias("n")).collect()}  # one row a folder
    for layer in range(deepest, -1, -1):
        if _with(j, "values", layer=layer):
            continue
        if layer == deepest:
            values = leaves.select("id", F.col("value").cast("int").alias("value"))
        else:
            step = _with(j, "values", layer=layer + 1)[0]
            below, known = j.read(step, "values"), -(-_rows([step], "values") // parts)
            for part in range(parts):
                if _with(j, "partial", layer=layer, part=part):
                    continue
                rows = sizes.get((layer, part), 0)
                found = valued(e.where((F.col("layer") == layer) & (F.col("part") == part)).select("src", "dst"), below.where(F.col("part") == part), rows, known)
                counts = (F.count_if(F.col("value") == v).alias(c) for c, v in COUNTS.items())
                j.commit({"partial": dealt(found.select(F.col("src").alias("id"), "value"), rows, "id").groupBy("id").agg(*counts)}, layer=layer, part=part)
            partial = _with(j, "partial", layer=layer)
            sums = dealt(_all([j.read(s, "partial") for s in partial]), _rows(partial, "partial"), "id").groupBy("id").agg(*(F.sum(c).alias(c) for c in COUNTS))
            values = sums.select("id", folded().cast("int").alias("value")).where("value is not null")
        j.commit({"values": values.withColumn("part", part_of("id", parts))}, folders={"values": ["part"]}, layer=layer)
    return _all([j.read(_with(j, "values", layer=k)[0], "values").select(F.lit(k).alias("layer"), "id", "value") for k in range(deepest + 1)])
