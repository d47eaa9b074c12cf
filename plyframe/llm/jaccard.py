"""Pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from a prefix filter. The shingles of a text are put in one order for all
texts. Of n shingles a partner holds at least 4n/5, so one of the first n - ceil(4n/5) + 1 is
among the first of the partner too: an equi-join on these finds every pair. Any order will do; shingles that are frequent in a bounded sample come
last, so few texts meet by them.

A candidate is first held against the sketches of both texts, counts of shingles by bucket of
their hash. Counts differ in sum by no more than the sets do, so a pair whose counts differ by
more than a ninth of both sizes is not similar, for certain. The texts themselves are read
only for the pairs that pass.

Members of a component need not all be compared. The texts of a key are first compared with
the one among them that shares most keys with others, then with the first such one that is
not connected to it; then only pairs that are not connected yet are. So a large group of near
copies costs a few comparisons a text, and no link between components is lost. The texts of
keys that still have many such pairs are brought together by the component of the text that
they were compared with, and dealt out in tiles, whose sketches are compared inside a task, so
only pairs that may be similar are written out, and once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plyframe.llm.common import LOWER, ByteWords, components, cut, few, mix64, stored, texts_together

WIDTH = 5
#: texts that are sampled to learn which shingles are frequent, from how many texts on, and
#: how many shingles are remembered; these set an order only, never what is found
SAMPLE, FREQUENT, REMEMBERED = 40_000, 3, 200_000
#: least number of buckets of a sketch; there are about n/8 for n shingles, a power of two
BUCKETS = 64
#: pairs a text of a key on average from which on the key is dealt out in tiles, and texts
#: of a block
CROWDED, BLOCK = 4, 512
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(b" \t\n\r\x0b\x0c")] = False


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of all five-word shingles of a text in UTF-8, repeats included; of all words
    where there are fewer."""
    words = ByteWords((text or b"").translate(LOWER), _IS_WORD).hash
    width = min(WIDTH, len(words))
    if not width:
        return words
    words = mix64(words)
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix64(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets is at least 4/5; of two empty ones too."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts, 255 at most, of a set of hashes by their highest bits."""
    bits = max(BUCKETS.bit_length() - 1, (len(s) // 8).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    return counts.astype(np.int32).reshape(size, -1).sum(axis=1)


def may_be_similar(n_a: int, a: np.ndarray, n_b: int, b: np.ndarray) -> bool:
    """False only for sets that are not similar. Cutting counts off at 255 and adding buckets
    up make their difference smaller, never larger."""
    if 5 * min(n_a, n_b) < 4 * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    return 9 * int(np.abs(folded(a, size) - folded(b, size)).sum()) <= n_a + n_b


def prefix(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Of a sorted set the first hashes that any similar set shares one of; those of the
    sorted array late come last."""
    n = len(s)
    if len(late) and n:
        at = np.minimum(np.searchsorted(late, s), len(late) - 1)
        s = s[np.argsort(late[at] == s, kind="stable")]
    return s[: n - (4 * n + 4) // 5 + 1]


def frequent(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in a sample of (t, text)."""
    step = max(1, texts.count() // SAMPLE)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            for x in d.column("text"):
                yield pa.RecordBatch.from_pydict({"key": np.unique(shingles(x.as_py())).view(np.int64)})

    sample = texts.where(f"pmod(t, {step}) = 0").select("text").mapInArrow(explode, "key long")
    top = sample.groupBy("key").count().where(f"count >= {FREQUENT}").orderBy(F.desc("count"), "key").limit(REMEMBERED)
    with texts_together(texts.sparkSession):
        return np.sort(np.array([r.key for r in top.select("key").collect()], dtype=np.int64).view(np.uint64))


def _both(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """df under the names of the first and of the second text of a pair."""
    return tuple(df.select(F.col("t").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in "ab")


def _ids(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())


def verified(pairs: DataFrame, marks: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of text numbers that are similar; marks are (t, n, sketch), texts
    (t, text), text in UTF-8, both with a row for every number, and equal rows for equal
    numbers. Texts pass one at a time, not in batches of objects."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ok = [may_be_similar(m, np.frombuffer(x, np.uint8), n, np.frombuffer(y, np.uint8)) for m, x, n, y in zip(d["n_a"], d["sketch_a"], d["n_b"], d["sketch_b"])]
            yield d.loc[ok, ["a", "b"]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            a, b = d.column("a").to_pylist(), d.column("b").to_pylist()
            out = []
            own, first = None, None
            for i, (x, y) in enumerate(zip(a, b)):
                if x != own:  # rows come by their first text, which many may share
                    own, first = x, np.unique(shingles(d.column("text_a")[i].as_py()))
                if similar(first, np.unique(shingles(d.column("text_b")[i].as_py()))):
                    out.append((x, y))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    pairs = cut(pairs.distinct())
    a, b = _both(stored(marks.join(few(_ids(pairs)), "t", "left_semi").select("t", "n", "sketch").dropDuplicates(["t"])), "n", "sketch")
    close = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInPandas(near, "a long, b long"))
    a, b = _both(stored(texts.join(few(_ids(close)), "t", "left_semi").select("t", "text").dropDuplicates(["t"])), "text")
    with texts_together(pairs.sparkSession):
        return cut(close.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of batches that are sorted by these numbers."""
    rest: pa.Table | None = None
    for d in batches:
        t = pa.Table.from_batches([d])
        t = t if rest is None else pa.concat_tables([rest, t])
        key = np.stack([t.column(c).to_numpy() for c in by])
        edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(edge, edge[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(edge[-1])
    if rest is not None:
        yield rest


def _tile(rows: pa.Table) -> list[tuple[int, int]]:
    """The pairs of a tile in different roots whose sketches allow them to be similar."""
    n, t, root, side = (rows.column(c).to_numpy() for c in ("n", "t", "root", "side"))
    own = [np.frombuffer(x.as_py(), np.uint8) for x in rows.column("sketch")]
    short = np.array([folded(x, BUCKETS) for x in own], dtype=np.int16)
    same = rows.column("ti")[0].as_py() == rows.column("tj")[0].as_py()
    out = []
    for i in np.flatnonzero(side == 0):
        j = np.arange(i + 1, len(n)) if same else np.flatnonzero(side == 1)
        j = j[(root[j] != root[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
        j = j[9 * np.abs(short[j] - short[i]).sum(axis=1) <= n[j] + n[i]] if len(j) else j
        out += [(min(int(t[i]), int(t[k])), max(int(t[i]), int(t[k]))) for k in j if may_be_similar(int(n[i]), own[i], int(n[k]), own[k])]
    return out


def _tiled(crowd: DataFrame) -> DataFrame:
    """(a, b): of distinct (crowd, t, n, root, sketch), the pairs of a crowd in different roots
    whose sketches allow them to be similar, each once. A tile holds two blocks of about
    ``BLOCK`` texts."""
    by = ["crowd", "ti", "tj"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, by):
            pairs = _tile(rows)
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([x for _, x in pairs], pa.int64())})

    sizes = crowd.groupBy("crowd").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks"))
    tiles = (
        crowd.join(sizes, "crowd")
        .withColumn("block", F.expr("int(pmod(xxhash64(t), blocks))"))
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("crowd", F.least("block", "with").alias("ti"), F.greatest("block", "with").alias("tj"), F.expr("int(block > with)").alias("side"), "t", "n", "root", "sketch")
        .repartition(*by)
        .sortWithinPartitions(*by)
    )
    return tiles.mapInArrow(compare, "a long, b long")


def links(marks: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): known pairs (a, b), and pairs of similar texts. Their components are those of
    the known and all similar pairs, of which some inside a component are left out. marks are
    (t, n, sketch, keys) with keys the prefix, empty where another row of the number has it."""
    keyed = marks.select("t", "n", F.posexplode("keys").alias("pos", "key"))
    # one shuffle of all keys; most stand alone and end here
    same = Window.partitionBy("key")
    keyed = keyed.withColumn("before", F.lag("t").over(same.orderBy("t"))).where("before is null or before <> t")
    shared = keyed.withColumn("after", F.lead("t").over(same.orderBy("t"))).where("before is not null or after is not null")
    shared = stored(shared.select("key", "t", "n", "pos", F.count("*").over(same).alias("m")))
    central = cut(shared.groupBy("t").agg(F.sum("m").alias("met")))
    fits = "5 * least(n, n0) >= 4 * greatest(n, n0)"
    # a similar pair shares 4/9 of both sizes, none of it before its first shared shingle
    left = "9 * least(n - pos, n0) >= 4 * (n + n0)"

    def star(rows: DataFrame, *order) -> DataFrame:
        """rows with the first of their key in this order: its number a, size and root."""
        first = F.first(F.struct("t", "n", "root")).over(same.orderBy(*order, F.desc("met"), "t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("f", first).select("*", F.col("f.t").alias("a"), F.col("f.n").alias("n0"), F.col("f.root").alias("root0")).drop("f")

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.where(f"root <> root0 and {fits} and {left}").select(F.least("a", "t").alias("a"), F.greatest("a", "t").alias("b"))

    found = cut(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def grown(pairs: DataFrame) -> None:
        nonlocal found
        found = found.unionByName(verified(pairs, marks, texts))

    def named(rows: DataFrame) -> DataFrame:
        roots = few(cut(components(found)))
        return rows.join(roots, rows.t == roots.node, "left").withColumn("root", F.coalesce("root", "t")).drop("node")

    met = shared.join(few(central), "t")
    first = stored(star(named(met)))
    grown(pairs_of(first))
    again = named(first.drop("root", "root0", "n0"))
    lead = F.max(F.when(F.col("t") == F.col("a"), F.col("root"))).over(same)
    again = again.withColumn("lead", lead).drop("a")
    grown(pairs_of(star(again, F.col("root") == F.col("lead"))))

    roots = few(cut(components(found)))
    of = lambda rows, t, root: rows.join(roots.select(F.col("node").alias(t), F.col("root").alias(root)), t, "left").withColumn(root, F.coalesce(root, t))
    rest = of(first.select("key", "t", "n", "pos", "a"), "t", "root")
    mixed = rest.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("own")).where("m * m > own")
    mixed = cut(mixed.select("key", F.expr(f"(m * m - own) / 2 > {CROWDED} * m").alias("crowded")))
    rest = stored(rest.join(mixed, "key").select("key", "t", "n", "pos", "root", "a", "crowded"))
    loose = rest.where("not crowded")
    second = loose.select("key", F.col("t").alias("b"), F.col("n").alias("n0"), F.col("pos").alias("pos0"), F.col("root").alias("root0"))
    ahead = f"root < root0 and {fits} and 9 * least(n - pos, n0 - pos0) >= 4 * (n + n0)"
    pairs = loose.join(second, "key").where(ahead).select(F.least("t", "b").alias("a"), F.greatest("t", "b").alias("b"))
    # the keys of near copies mostly have one text in their middle: one crowd, compared once
    crowd = stored(of(rest.where("crowded"), "a", "crowd").select("crowd", "t", "n", "root").distinct())
    sketches = stored(marks.join(few(cut(crowd.select("t").distinct())), "t", "left_semi").select("t", "sketch").dropDuplicates(["t"]))
    grown(pairs.unionByName(_tiled(crowd.join(sketches, "t"))))
    return found
