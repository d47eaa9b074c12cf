"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four 16-bit segments. If two fingerprints differ in at
most three bits, then for some i segment i agrees exactly and segment i+1 (cyclically)
differs in at most one bit: with the errors spread over the segments, at most one
segment can hold two or three of them, and no two exact segments have it as their
successor. Segment i+1, seen as a word of the perfect (23,12) Golay code, is decoded to
the index of its codeword; a word at distance three from it also takes the five codewords
at distance four, since only such words have a one-bit neighbour that decodes elsewhere.
So two words that differ in one bit always share an index. Every fingerprint gets
4 to 24 keys of 28 bits, an equi-join on the key finds all pairs, and the pairs are
verified by their Hamming distance. No link is lost, and no cap is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm import jaccard
from plyframe.llm.common import LOWER, components, cut, few, stored, table, texts_together

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: generator polynomial of the (23,12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1: a fixed value
GENERATOR = 0b110001110101


def fingerprint(text: str | bytes | None, width: int = SHINGLE_WORDS) -> int:
    """Bit majority of the XXH64 values of all word shingles; zero without words."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :] - 1
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 16):  # bounded memory for very long texts
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[lo : min(n, lo + (1 << 16))].tolist(), ends[lo : lo + (1 << 16)].tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where((v >> bit) & 1, GENERATOR << (bit - 11), 0)
    return v


@cache
def golay_keys() -> np.ndarray:
    """For every 16-bit word its one or six codeword indices, -1 where there is no more."""
    words = np.arange(1 << 23, dtype=np.int32)
    weight = np.bitwise_count(words)
    light = words[weight <= 3]
    leader = np.empty(1 << 11, dtype=np.int32)
    leader[_syndrome(light)] = light  # perfect code: each syndrome once
    heavy = words[weight == 7]
    sevens = heavy[_syndrome(heavy) == 0]
    v = np.arange(1 << 16, dtype=np.int32)
    error = leader[_syndrome(v)]
    keys = np.full((1 << 16, 6), -1, dtype=np.int64)
    keys[:, 0] = (v ^ error) >> 11
    for x in v[np.bitwise_count(error) == 3]:
        e = error[x]
        keys[x, 1:] = (x ^ e ^ sevens[(sevens & e) == e]) >> 11
    return keys


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) of every key."""
    own = golay_keys()
    seg = [((fp >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    at, out = [], []
    for i in range(4):
        k = own[seg[(i + 1) % 4]]
        r, c = np.nonzero(k >= 0)
        at.append(r)
        out.append((i << 28) | (seg[i][r] << 12) | k[r, c])
    return np.concatenate(at), np.concatenate(out)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and ``fp`` (signed long). A scan without a shuffle."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", of(F.col(text)))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints in the column ``fp`` at most
    three bits apart. A fingerprint has few such partners, as distinct words so close
    are few, so the pairs grow with the distinct fingerprints, not with the copies."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            fp = d["fp"].to_numpy(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 1 << 14):
                part = fp[lo : lo + (1 << 14)]
                at, key = keys_of(part)
                yield pd.DataFrame({"key": key, "fp": part[at].view(np.int64)})

    keyed = fps.select("fp").mapInPandas(explode, "key long, fp long")
    a, b = keyed.select("key", F.col("fp").alias("a")), keyed.select("key", F.col("fp").alias("b"))
    return a.join(b, "key").where("a < b and bit_count(a ^ b) <= " + str(MAX_BITS)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id among the rows
    whose fingerprints are reachable by links.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows
    that repeat an id are rows of their own and share the id. A null id is never the
    smallest unless it stands alone, when component_id is null. Extra columns, whatever
    their names, are left out. An empty table gives an empty table.
    """
    marked = cut(fingerprints(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = cut(distinct)
    roots = components(links(distinct))
    near = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = near.groupBy("root").agg(F.min("low").alias("component_id"))
    named = near.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(rows: DataFrame, late: np.ndarray) -> DataFrame:
    """(doc_id, t, fp, n, sketch, keys) of (doc_id, t, text), in one scan: the fingerprint, and
    what jaccard.links needs. text is in UTF-8; texts pass one at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text in a task
        for d in batches:
            t = d.column("t").to_pylist()
            fp, n, sketch, keys = [], [], [], []
            for i, text in zip(t, d.column("text")):
                text = text.as_py()
                s = np.unique(jaccard.shingles(text))
                fp.append(fingerprint(text))
                n.append(len(s))
                sketch.append(jaccard.sketch(s).tobytes())
                keys.append(jaccard.prefix(s[:0] if i in seen else s, late).view(np.int64))
                seen.add(i)
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": d.column("doc_id"),
                    "t": d.column("t"),
                    "fp": np.array(fp, dtype=np.uint64).view(np.int64),
                    "n": pa.array(n, pa.int32()),
                    "sketch": pa.array(sketch, pa.binary()),
                    "keys": pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *keys])),
                }
            )

    return rows.mapInArrow(scan, "doc_id long, t long, fp long, n int, sketch binary, keys array<long>")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: texts whose fingerprints are at most
    three bits apart, or with a Jaccard similarity of five-word shingles of 0.8 or more, and
    all that these links lead to.

    At a similarity of 0.8 fingerprints differ by about ten bits, which no number of Golay
    keys covers; so jaccard.links adds, to the groups that the keys find, the similar texts
    beyond them. Of a group the row with the smallest doc_id stays, of rows
    that share it one with the smallest hash of its text; a row without an id stays only
    where no member has one. Wordless and null texts are copies of each other. Repeated rows
    are copies; of those that differ in other columns one stays, by the order of their JSON
    form. An empty table gives an empty table. Columns unchanged, whatever their names.
    """
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    texts = rows.select("t", "text")
    late = jaccard.frequent(texts)
    with texts_together(docs.sparkSession):
        marks = stored(_marks(rows, late))
    firsts = cut(marks.groupBy("fp").agg(F.min("t").alias("t")))
    equal = marks.select("fp", F.col("t").alias("b")).distinct().join(firsts.select("fp", F.col("t").alias("a")), "fp").where("a <> b").select("a", "b")
    near = links(firsts)
    near = near.join(firsts.select(F.col("fp").alias("a"), F.col("t").alias("ta")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("t").alias("tb")), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    roots = cut(components(jaccard.links(marks, texts, equal.unionByName(near))))

    ids = marks.select("doc_id", "t").join(few(roots), F.col("t") == F.col("node"), "left").select("doc_id", "t", F.coalesce("root", "t").alias("root"))
    stays = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "t"))
    groups = cut(ids.groupBy("root").agg(F.count("*").alias("k"), stays.alias("s")).where("k > 1").select("root", "s.doc_id", "s.t"))
    members = ids.join(few(groups.select("root", F.col("doc_id").alias("d1"), F.col("t").alias("t1"))), "root")
    members = cut(members.groupBy("doc_id", "t").agg(F.count("*").alias("k"), F.first(F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1"))).alias("stays")))
    own = docs.withColumn("__ply_t", F.xxhash64("text")).withColumn("__ply_d", F.col("doc_id").cast("long"))
    key = lambda m: F.col("__ply_d").eqNullSafe(m["d2"]) & (F.col("__ply_t") == m["t2"])
    out = members.where("not stays or k > 1").select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"))
    again = members.where("stays and k > 1").select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"))
    single = own.join(few(out), key(out), "left_anti").select(names)
    if again.isEmpty():
        return single
    whole = F.struct(*[F.col(c) for c in names])
    repeated = own.join(few(again), key(again), "left_semi").groupBy("__ply_d", "__ply_t").agg(F.min_by(whole, F.to_json(whole)).alias("__ply_r"))
    return single.unionByName(repeated.select("__ply_r.*"))
