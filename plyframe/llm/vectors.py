"""Near-duplicate embeddings by randomised-rotation binary codes.

Equal vectors are one representative with a multiplicity. Every pair of representatives of a
label and a length is estimated: a representative is rotated at random and its signs are
stored as bits, which give an unbiased estimate of a pair's inner product,
<s_x, y> / (sqrt(d) f_x), where f_x is the stored correction factor of x. Pairs whose confidence bound stays below the
threshold are dropped; for the rest the cosine is computed in double precision.

The pairs are dealt out as tiles of two blocks of about ``TILE`` rows, so the work grows with
the square of a label's distinct vectors. Pairs are counted inside a tile and never written
out: a tile gives its rows' link counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import components, connected, few, stored, table

THRESHOLD = 0.93
TILE = 2048
#: width of the confidence bound in standard deviations of the estimate's error
SIGMAS = 6.0


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20_000 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The signs after the rotation (n, dim) and the correction factors."""
    turned = unit @ rotation(unit.shape[1])
    return turned > 0, np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def turned(unit: np.ndarray) -> np.ndarray:
    """A block after the rotation, in single precision: what estimates are made of."""
    return (unit @ rotation(unit.shape[1])).astype(np.float32)


def signs_of(codes: list[bytes], dim: int) -> np.ndarray:
    """Stored codes as +1 and -1."""
    raw = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(len(codes), -(-dim // 8))
    return np.unpackbits(raw, axis=1)[:, :dim].astype(np.float32) * 2 - 1


def linked_pairs(unit_a, unit_b, factor_a, threshold: float = THRESHOLD, signs_a=None, turned_b=None):
    """Index pairs of rows whose cosine reaches the threshold: estimate, bound, verify. The
    estimate is one product in single precision, whose rounding the bound allows for; signs
    and the rotated block are made here unless they are given."""
    dim = unit_a.shape[1]
    if signs_a is None:
        signs_a = np.where(encode(unit_a)[0], 1, -1).astype(np.float32)
    if turned_b is None:
        turned_b = turned(unit_b)
    estimate = signs_a @ turned_b.T
    spread = np.sqrt(np.maximum(0, 1 - factor_a**2)) / factor_a * np.sqrt((1 - threshold**2) / max(1, dim - 1))
    rounding = 1e-9 + 4 * dim * float(np.finfo(np.float32).eps) / factor_a
    # the least product of signs that may still belong to a link
    least = (threshold - SIGMAS * spread - rounding) * np.sqrt(dim) * factor_a
    i, j = np.nonzero(estimate >= least[:, None])
    out_i, out_j = [], []
    for lo in range(0, len(i), 1 << 16):
        x, y = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        ok = np.einsum("nd,nd->n", unit_a[x], unit_b[y]) >= threshold
        out_i.append(x[ok])
        out_j.append(y[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def _unit(raw, dim: int) -> np.ndarray:
    kind = np.float32 if len(raw.iloc[0] if isinstance(raw, pd.Series) else raw[0]) == 4 * dim else np.float64
    v = np.stack([np.frombuffer(x, dtype=kind) for x in raw]).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _tile(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tile: ids, their link counts, and edges of a spanning forest."""
    dim = int(rows["dim"].iat[0])
    side = rows["side"].to_numpy()
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = rows["ti"].iat[0] == rows["tj"].iat[0]  # the other block may be empty
    unit, factor = _unit(rows["vec"], dim), rows["factor"].to_numpy()
    ids, times = rows["rid"].to_numpy(), rows["times"].to_numpy()
    links = np.zeros(len(rows), dtype=np.int64)
    all_i, all_j = [], []
    other = a if same else b
    signs, beside = signs_of(list(rows["code"]), dim), turned(unit[other])
    for lo in range(0, len(a), 256):
        mine = a[lo : lo + 256]
        i, j = linked_pairs(unit[mine], unit[other], factor[mine], signs_a=signs[mine], turned_b=beside)
        i, j = mine[i], other[j]
        if same:
            i, j = i[i < j], j[i < j]
        links += np.bincount(i, weights=times[j], minlength=len(rows)).astype(np.int64)
        links += np.bincount(j, weights=times[i], minlength=len(rows)).astype(np.int64)
        all_i.append(i)
        all_j.append(j)
    i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (all_i, all_j))
    low = connected(len(rows), i, j) if len(i) else np.arange(len(rows))
    on = np.flatnonzero(low != np.arange(len(rows)))
    counted = np.flatnonzero(links)
    return ids[counted], links[counted], ids[on], ids[low[on]]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by tile; a tile is at most 2 * TILE rows and may span batches."""
    by = ["label", "dim", "ti", "tj"]
    rest: pd.DataFrame | None = None

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        out = [_tile(x) for _, x in rows.groupby(by, sort=False) if len(x) > 1]
        if not out:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype({"a": "Int64", "b": "Int64", "n": "Int64"})
        ids, n, a, b = (np.concatenate(x) for x in zip(*out))
        total = pd.Series(n).groupby(ids).sum()
        return pd.concat(
            [
                pd.DataFrame({"a": pd.array(total.index, dtype="Int64"), "b": pd.array([None] * len(total), dtype="Int64"), "n": pd.array(total.to_numpy(), dtype="Int64")}),
                pd.DataFrame({"a": pd.array(a, dtype="Int64"), "b": pd.array(b, dtype="Int64"), "n": pd.array([None] * len(a), dtype="Int64")}),
            ]
        )

    for d in batches:
        d = d if rest is None else pd.concat([rest, d], ignore_index=True)
        last = (d[by] == d[by].iloc[-1]).all(axis=1).to_numpy()
        rest = d[last]
        if not last.all():
            yield done(d[~last])
    if rest is not None:
        yield done(rest)


def near_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label).

    Null, empty and zero vectors, those with null or non-finite components, rows with a
    null label and rows without an id are linked with nothing; vectors of different length
    too. Repeated rows are vectors of their own and linked with each other; rows that share
    an id share a component. Extra columns are left out. An empty table gives no rows.
    """
    real = "float" if dict(rows.dtypes)["embedding"] == "array<float>" else "double"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{real}>").alias("v"))
    bad = f"exists(v, x -> x is null or isnan(x) or abs(x) = {real}('infinity')) or not exists(v, x -> x <> 0)"
    good = rows.where(f"vec_id is not null and label is not null and v is not null and size(v) > 0 and not ({bad})").withColumn("h", F.xxhash64("v"))
    reps = stored(good.groupBy("label", "h", "v").agg(F.min("vec_id").alias("rid"), F.count("*").alias("times")))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            dims = np.array([len(x) for x in d["v"]])
            for dim in np.unique(dims):
                part = d[dims == dim]
                raw = [np.asarray(x, dtype=np.float32 if real == "float" else np.float64).tobytes() for x in part["v"]]
                positive, factor = encode(_unit(raw, int(dim)))
                codes = [x.tobytes() for x in np.packbits(positive, axis=1)]
                yield pd.DataFrame({"rid": part["rid"], "label": part["label"], "times": part["times"], "dim": int(dim), "vec": raw, "code": codes, "factor": factor})

    marked = stored(reps.select("rid", "label", "times", "v").mapInPandas(mark, "rid long, label long, times long, dim long, vec binary, code binary, factor double"))
    sizes = few(stored(marked.groupBy("label", "dim").agg(F.expr(f"int(ceil(count(*) / {TILE}))").alias("blocks"))), "3")
    # a row goes to the tiles that compare its block with each other block
    tiles = (
        marked.join(sizes, ["label", "dim"])
        .withColumn("block", F.expr("int(pmod(xxhash64(rid), blocks))"))
        .withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("label", "dim", F.least("block", "with").alias("ti"), F.greatest("block", "with").alias("tj"), F.expr("int(block > with)").alias("side"), "rid", "times", "vec", "code", "factor")
        .repartition("label", "dim", "ti", "tj")
        .sortWithinPartitions("label", "dim", "ti", "tj")
    )
    found = stored(tiles.mapInPandas(_compare, "a long, b long, n long"))
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null"))
    named = (
        reps.join(counts, reps.rid == counts.a, "left")
        .join(roots, reps.rid == roots.node, "left")
        .select(F.col("label").alias("_l"), F.col("h").alias("_h"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "rid").alias("component_id"))
    )
    linked = rows.withColumn("h", F.xxhash64("v"))
    out = linked.join(named, (linked.label == named._l) & (linked.h == named._h) & (linked.v == named._v) & linked.vec_id.isNotNull(), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
ok as (select * from v where vec_id is not null and label is not null and e is not null and len(e) > 0
       and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
          where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach as (with recursive r(a, b) as (select a, b from links union select r.a, l.b from r join links l on r.b = l.a) select a, min(b) as low from r group by a),
n as (select a, count(*) as k from links group by a)
select v.vec_id, coalesce(n.k, 0) as n_links, least(v.vec_id, coalesce(reach.low, v.vec_id)) as component_id,
       v.vec_id = least(v.vec_id, coalesce(reach.low, v.vec_id)) as kept
from v left join n on v.vec_id = n.a left join reach on v.vec_id = reach.a
"""
