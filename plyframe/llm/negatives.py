"""Mining of hard negatives by exact integer inner products, pruned after a rotation.

An orthogonal rotation to principal components leaves inner products as they are and moves
most of each vector into its leading components. Partial products over these are added up a
few components at a time; what is missing is at most the product of the two residual norms,
and the rotation's own rounding is bounded too, so a pair whose bounds miss every wanted score
is discarded early, and no wanted one. The rest is scored by integer products.

Anchors are compared with all rows in tiles of two bounded blocks, dealt by hashes, so a label
with a third of all rows is as many more tiles. A tile gives its first few rows of each anchor
and window; the first of those, over the tiles, are the result. First come the positives, then
the negatives in the windows of scores that the positives set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.llm.common import few, stored, table

#: rows of a block, on either side of a tile
ANCHORS, ROWS = 16_384, 4096
#: rows that the rotation is fitted to, those with the smallest hashes: it steers only how
#: early pairs are discarded
SAMPLE = 4096
#: components after which bounds are tried, as shares of all
STAGES = (0.125, 0.25, 0.5)
#: squared norms stay below, so every product fits a LONG and every component 32 bits
MOST_NORM = float(1 << 62)
_ANY = np.int64(1 << 62)


def fit_rotations(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length in a sample of packed rows (id, dim, q) an orthogonal matrix, principal
    components of the second moments first. Lengths outside the sample keep their components."""
    sample = rows.orderBy(F.xxhash64("id"), "id").select("dim", "q").limit(SAMPLE).collect()  # at most SAMPLE rows
    by: dict[int, list[bytes]] = {}
    for r in sample:
        by.setdefault(r.dim, []).append(bytes(r.q))
    out = {}
    for dim, packed in by.items():
        if dim:
            x = np.frombuffer(b"".join(packed), dtype="<i4").reshape(-1, dim).astype(np.float64)
            x /= max(1.0, np.abs(x).max())
            out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


class Block:
    """Integer vectors with their rotation and, at each stage, the norms of what is left."""

    def __init__(self, packed: list[bytes], dim: int, rotation: np.ndarray | None):
        self.whole = np.frombuffer(b"".join(packed), dtype="<i4").reshape(len(packed), dim).astype(np.int64)
        self.turned = self.whole.astype(np.float64)
        if rotation is not None:
            self.turned = self.turned @ rotation
        self.norm = np.sqrt(np.einsum("nd,nd->n", self.turned, self.turned))
        self.stages = sorted({min(dim, max(1, round(dim * s))) for s in STAGES})
        self.rest = {k: np.sqrt(np.einsum("nd,nd->n", self.turned[:, k:], self.turned[:, k:])) for k in self.stages}


def slack_of(rotation: np.ndarray | None, dim: int) -> float:
    """How much a product of rotated vectors, as computed, and the bounds may be off, as a
    share of the product of the norms: the rotation's distance from an orthogonal one, and
    rounding in rotating, adding up and in the norms."""
    eps = np.finfo(np.float64).eps
    off = 0.0 if rotation is None else float(np.linalg.norm(rotation @ rotation.T - np.eye(dim)))
    return off + 16 * (dim + 4) ** 1.5 * eps


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first k of their query: high scores, then small ids."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def search(a: Block, b: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int, slack: float):
    """For each row of a and each of its windows low[:, w] <= score <= high[:, w] (integers, a
    missing window has low > high) the first k allowed rows of b: (row, window, row of b,
    score), and how many pairs got an integer product. low rises while rows are found."""
    low, (n, windows) = low.copy(), low.shape
    kept = [np.zeros(0, dtype=np.int64)] * 4
    exact = 0
    for lo in range(0, len(b.norm), 512):
        cols = slice(lo, min(lo + 512, len(b.norm)))
        loose = slack * a.norm[:, None] * b.norm[None, cols]
        alive, partial, done = allowed[:, cols].copy(), np.zeros(loose.shape), 0
        for s in a.stages:
            if not alive.any():
                break
            partial += a.turned[:, done:s] @ b.turned[cols, done:s].T
            done = s
            room = a.rest[s][:, None] * b.rest[s][None, cols] + loose
            most, least = partial + room, partial - room
            wanted = np.zeros_like(alive)
            for w in range(windows):
                wanted |= (most >= low[:, w : w + 1].astype(np.float64)) & (least <= high[:, w : w + 1].astype(np.float64))
            alive &= wanted
        i, j = np.nonzero(alive)
        exact += len(i)
        got = [np.zeros(0, dtype=np.int64)] * 4
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)] + lo
            score = np.einsum("nd,nd->n", a.whole[x], b.whole[y])
            for w in range(windows):
                ok = (score >= low[x, w]) & (score <= high[x, w])
                got = [np.concatenate(z) for z in zip(got, (x[ok], np.full(ok.sum(), w), y[ok], score[ok]))]
        if not len(got[0]):
            continue
        kept = [np.concatenate(z) for z in zip(kept, got)]
        query = kept[0] * windows + kept[1]
        best = _first(query, kept[3], ids[kept[2]], k)
        kept = [z[best] for z in kept]
        query, score = query[best], kept[3]
        # where k rows were found, the last of them is the least score that still matters
        size = np.bincount(query, minlength=n * windows)
        worst = np.full(n * windows, _ANY)
        np.minimum.at(worst, query, score)
        flat = low.reshape(-1)
        full = size >= k
        flat[full] = np.maximum(flat[full], worst[full])
    return *kept, exact


def _tiles(anchors: DataFrame, rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to tiles: blocks of about ANCHORS and ROWS rows, each with each."""
    size = lambda df, most, c: df.groupBy(by).agg(F.expr(f"int(ceil(count(*) / {most}))").alias(c))
    sizes = few(stored(size(anchors, ANCHORS, "na").join(size(rows, ROWS, "nr"), by)), f"{len(by)} + 2")
    left = anchors.join(sizes, by).withColumn("ti", F.expr("int(pmod(xxhash64(id), na))")).withColumn("tj", F.explode(F.expr("sequence(0, nr - 1)"))).drop("na", "nr")
    right = rows.join(sizes, by).withColumn("tj", F.expr("int(pmod(xxhash64(id, 1), nr))")).withColumn("ti", F.explode(F.expr("sequence(0, na - 1)"))).drop("na", "nr")
    return left, right, [*by, "ti", "tj"]


_FOUND = "anchor long, high long, other long, score long, exact long"


def _matcher(rotations: dict[int, np.ndarray], k: int, same: bool):
    """What a tile does: the first k of each anchor and window, rows of the same label or of
    others; a row is not its own."""

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            dim = int(left["dim"].iat[0])
            turn = rotations.get(dim)
            slack = slack_of(turn, dim)
            b, ids, labels = Block(list(right["q"]), dim, turn), right["id"].to_numpy(), right["label"].to_numpy()
            for lo in range(0, len(left), 256):
                part = left.iloc[lo : lo + 256]
                mine, own = part["id"].to_numpy(), part["label"].to_numpy()
                if same:
                    allowed = (own[:, None] == labels[None, :]) & (mine[:, None] != ids[None, :])
                    low, high = np.full((len(part), 1), -_ANY), np.full((len(part), 1), _ANY)
                else:
                    allowed = own[:, None] != labels[None, :]
                    most = max(map(len, part["highs"]))
                    low, high = np.full((len(part), most), _ANY), np.full((len(part), most), -_ANY)
                    for r, (lows, highs) in enumerate(zip(part["lows"], part["highs"])):
                        low[r, : len(lows)], high[r, : len(highs)] = lows, highs
                i, w, j, score, exact = search(Block(list(part["q"]), dim, turn), b, allowed, low, high, ids, k, slack)
                top = np.zeros(len(i), dtype=np.int64) if same else np.array([part["highs"].iat[x][y] for x, y in zip(i, w)], dtype=np.int64)
                out.append(pd.DataFrame({"anchor": mine[i], "high": top, "other": ids[j], "score": score, "exact": exact}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: np.zeros(0, dtype=np.int64) for c in _FOUND.split(", ")})

    return match


def _matched(anchors: DataFrame, rows: DataFrame, by: list[str], f) -> DataFrame:
    again = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # anchors are some of the rows
    left, right, keys = _tiles(again, rows, by)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(f, _FOUND)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integer_rows(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, dim, q) of rows (id, label, v): each component floor(scale * x), packed in
    32 bits; stored. Left out are rows without id, label or vector, with null or non-finite
    components, and those whose squared norm would leave a LONG. An id is one vector: of rows
    that repeat it the least by label, then vector, counts."""
    good = rows.where("id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    whole = good.select("id", "label", F.transform("v", lambda x: F.floor(scale * x)).alias("v"))
    whole = whole.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < MOST_NORM)
    one = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b.column(2).flatten().to_numpy().astype("<i4"), np.cumsum([0, *b.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([flat[at[i] : at[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], ["id", "label", "dim", "q"])

    sized = one.select("id", "label", "v", F.size("v").cast("long").alias("dim"))
    return stored(sized.mapInArrow(pack, "id long, label long, dim long, q binary"))


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    row that is_anchor holds for (a condition on ``id``) and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of other labels whose score is
    between least / 100 and most / 100 of the positive's. rows are those of integer_rows;
    scores are inner products, high ones first, then small ids.

    Vectors of different lengths are not compared; an empty vector scores 0 with every other.
    Anchors without another row of their label, or without a row in the window, give no rows;
    so does a window that is empty as the positive's score is negative. An empty table gives
    none. Equal vectors under different ids are rows of their own.
    """
    rotations = fit_rotations(rows)
    anchors = rows.where(is_anchor)
    near = stored(_ranked(_matched(anchors, rows, ["label", "dim"], _matcher(rotations, positives, True)), ["anchor"], positives).select("anchor", "other", "score"))
    # scores s with least * p <= 100 * s <= most * p, as whole numbers
    share = lambda f, k: F.expr(f"cast({f}(cast(score as decimal(19, 0)) * {int(k)} / 100) as bigint)")
    windows = near.select("anchor", share("ceil", least).alias("low"), share("floor", most).alias("high"), "score").where("low <= high")
    asked = windows.groupBy(F.col("anchor").alias("id")).agg(F.array_sort(F.collect_set(F.struct("high", "low"))).alias("w"))
    asked = anchors.join(asked, "id").select("id", "label", "dim", "q", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = _matched(asked, rows, ["dim"], _matcher(rotations, negatives, False))
    best = _ranked(found, ["anchor", "high"], negatives).select("anchor", "high", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = windows.select("anchor", "high", F.col("score").alias("positive_score")).distinct()
    named = near.select("anchor", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(pairs, ["anchor", "positive_score"]).join(best, ["anchor", "high"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = integer_rows(e.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("v")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
           where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.id as a, b.id as b, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as s from v a join v b on a.id <> b.id and len(a.e) = len(b.e) where a.id % 100 = 0),
pos as (select a, b, s from (select *, row_number() over (partition by a order by s desc, b) as k from p where same) where k <= 5),
neg as (select pos.a, pos.b, pos.s, p.b as n, p.s as t, row_number() over (partition by pos.a, pos.b order by p.s desc, p.b) as k
        from pos join p on p.a = pos.a and not p.same where 80 * pos.s <= 100 * p.s and 100 * p.s <= 100 * pos.s)
select a as anchor_id, b as positive_id, cast(k as int) as rank, n as negative_id, s as positive_score, t as negative_score from neg where k <= 5
"""
