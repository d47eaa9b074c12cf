"""Groups of states that look alike, by colour refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.persist import cut
from plyframe.plans.journal import in_buckets


def refine(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, class) of every state in edges (src, dst): states of a class, named by its smallest
    id, had the same colour before each round, and before the last as many edges to and from
    states of each colour. Without ``rounds`` it goes on until no class splits; then a symmetry
    of the graph maps every state into its own class. Repeated edges count. Null ends are
    ignored.

    A round adds up, over the edges of each state, hashes of the colour at their other end, so
    no list of neighbours is built: a state with a third of all edges is as many partial sums.
    A colour is two hashes of 64 bits until the end, where classes get their names; both would
    have to agree for a mistake. The edges are in buckets of their other end, so a round
    moves the states and the sums.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst"))
    way = lambda a, b, k: F.struct(F.col(a).cast("long").alias("id"), F.col(b).cast("long").alias("other"), F.lit(k).alias("way"))
    both = e.select(F.explode(F.array(way("src", "dst", 0), way("dst", "src", 1))).alias("x")).select("x.*")
    both = in_buckets(both, "other", 2 * e.count())
    zero = F.lit(0).cast("long")
    now = cut(both.select(F.col("other").alias("id")).distinct().select("id", zero.alias("c1"), zero.alias("c2")))
    classes, n = 0, 0
    while rounds is None or n < rounds:
        n += 1
        ends = both.join(now.select(F.col("id").alias("other"), "c1", "c2"), "other")
        ends = ends.select("id", *(F.xxhash64(F.lit(seed), "way", "c1", "c2").alias(f"h{seed}") for seed in (1, 2)))
        half = lambda h: (F.sum(F.col(h).bitwiseAND(F.lit((1 << 32) - 1))), F.sum(F.shiftright(h, 32)))  # noqa: E731  # neither can overflow
        sums = [x.alias(f"s{k}") for k, x in enumerate((*half("h1"), *half("h2")))]
        own = now.select("id", "c1", "c2", *(F.lit(None).cast("long").alias(h) for h in ("h1", "h2")))
        signs = ends.select("id", *(F.lit(None).cast("long").alias(c) for c in ("c1", "c2")), "h1", "h2").unionByName(own).groupBy("id").agg(F.max("c1").alias("c1"), F.max("c2").alias("c2"), *sums)
        sign = ["c1", "c2", "s0", "s1", "s2", "s3"]
        now = cut(signs.select("id", *(F.xxhash64(F.lit(seed + 2), *sign).alias(f"c{seed}") for seed in (1, 2))))
        if rounds is None:
            found = now.select("c1", "c2").distinct().count()
            if found == classes:
                break
            classes = found
    least = now.groupBy("c1", "c2").agg(F.min("id").alias("class"))
    return now.join(least, ["c1", "c2"]).select("id", "class")
