"""Document fingerprints by a randomised edit embedding.

A walk over a text writes the character under a pointer at each step and then moves the
pointer on or not, by a random bit that all texts share for that step and character. Equal
stretches of two texts are walked alike once their pointers have met, so a few edits change
few of the steps: edit distance becomes Hamming distance. The whole text is walked, twice its
length in steps, about.

The fingerprint keeps a sample of the walk, one step out of each 2^level, where the level
follows the length, so that a text has at most about ``SAMPLES``. The step kept by a block of
2^level is one of those that its two halves keep, so a fingerprint of a longer text is
compared with one of a shorter by thinning the shorter's. Likeness is the share of samples
that agree, those past an end counting as different.

Similar fingerprints are found by bands of ``BAND`` samples: two that agree in four fifths of
their samples have an equal band among any (one more than a fifth) bands of either, so a query
asks for its rarest ones only. Samples are then compared.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import mix64, stored, table, texts_together

SAMPLES = 256
BAND = 4
LEAST = 0.8
SEED = 12
#: steps whose random bits are made together
STEPS = 4096
#: characters that a task walks together; texts of one level up to which they go one by one
TOGETHER, ALONE = 12 << 20, 64


@lru_cache(maxsize=32)
def coins(block: int) -> np.ndarray:
    """(STEPS, 256): whether a step of the block moves on, for each class of characters; class 0
    stands for the end, where the pointer stays."""
    raw = np.random.default_rng([SEED, block]).bytes(STEPS * 32)
    out = np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(STEPS, 256)
    out[:, 0] = 0
    return out


def level_of(n: int) -> int:
    """The least level at which 2n steps give at most SAMPLES samples."""
    return max(0, (-(-2 * n // SAMPLES) - 1).bit_length()) if n else 0


def kept(m: np.ndarray, high: int, low: int = 0) -> np.ndarray:
    """Where the samples m of level ``high`` are among those of level ``low``; at level 0 these
    are the steps."""
    m = np.asarray(m, dtype=np.uint64)
    for level in range(high, low, -1):
        m = m * np.uint64(2) + (mix64(m + (np.uint64(level) << np.uint64(48))) & np.uint64(1))
    return m.astype(np.int64)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as bytes 1 to 255, each text followed by 0, and where they begin."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.zeros(start[-1], dtype=np.uint8)
    for at, t in zip(start.tolist(), texts):
        if t.isascii():
            out[at : at + len(t)] = np.frombuffer(t.encode(), dtype=np.uint8) + 1
        else:
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            out[at : at + len(t)] = np.where(c < 128, c + 1, 129 + (c * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(127))
    return out, start[:-1]


def _places(block: int, m: int, level: int) -> list[int]:
    """The steps of a block that are kept, from sample m on."""
    most = (STEPS >> level) + 2
    at = kept(np.arange(m, m + most), level) - block * STEPS
    return at[at < STEPS].tolist()


def _walk_together(data: np.ndarray, at: np.ndarray, level: int) -> list[bytes]:
    """The samples of texts of one level, a step of all at a time."""
    at, c, go = at.copy(), np.zeros(len(at), dtype=np.uint8), np.zeros(len(at), dtype=np.uint8)
    out: list[np.ndarray] = []
    look, add = data.take, np.add
    block = 0
    while True:
        rows = list(coins(block))
        places = _places(block, len(out), level)
        for done, p in zip([0, *places], [*places, STEPS]):
            for row in rows[done:p]:
                look(at, None, c, "clip")
                row.take(c, None, go, "clip")
                add(at, go, at)
            if p < STEPS:
                out.append(data[at])
                if not out[-1].any():
                    break
        if out and not out[-1].any() or not data[at].any():
            samples = np.stack(out, axis=1)
            return [x.tobytes().rstrip(b"\0") for x in samples]
        block += 1


def _walk_alone(data: bytes, at: list[int], level: int) -> list[bytes]:
    """The same, a text at a time within a block of steps: for few texts, which may be long."""
    at, found = list(at), [bytearray() for _ in at]
    block, m = 0, 0
    going = list(range(len(at)))
    while going:
        rows = list(map(bytes, coins(block)))
        places = _places(block, m, level)
        m += len(places)
        for k in going:
            i, done = at[k], 0
            for p in places:
                for row in rows[done:p]:
                    i += row[data[i]]
                done = p
                if not data[i]:
                    break
                found[k].append(data[i])
            for row in rows[done:]:
                i += row[data[i]]
            at[k] = i
        going = [k for k in going if data[at[k]]]
        block += 1
    return [bytes(x) for x in found]


def fingerprints(texts: list[str]) -> list[tuple[int, bytes]]:
    """(level, samples) of each text."""
    data, start = classes(texts)
    levels = np.array([level_of(len(t)) for t in texts], dtype=np.int64)
    out: list = [None] * len(texts)
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        if len(rows) > ALONE:
            got = _walk_together(data, start[rows], int(level))
        else:
            got = []
            for r in rows:
                got += _walk_alone(data[start[r] : start[r] + len(texts[r]) + 1].tobytes(), [0], int(level))
        for r, g in zip(rows, got):
            out[r] = (int(level), g)
    return out


def likeness(a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
    """The share of samples that agree at the coarser level of the two; 1 for two empty texts."""
    if a == b:
        return 1.0
    (low, x), (high, y) = sorted((a, b), key=lambda p: p[0])
    x, y = thinned((low, x), high), np.frombuffer(y, dtype=np.uint8)
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / max(len(x), len(y), 1)


def thinned(print_: tuple[int, bytes], level: int) -> np.ndarray:
    """The samples that the text has at a coarser level."""
    x = np.frombuffer(print_[1], dtype=np.uint8)
    if level == print_[0]:
        return x
    at = kept(np.arange((len(x) >> (level - print_[0])) + 1), level, print_[0])
    return x[at[at < len(x)]]


def shown(print_: tuple[int, bytes]) -> str:
    return f"{print_[0]}:{base64.b64encode(print_[1]).decode()}"


def parsed(text: str) -> tuple[int, bytes]:
    level, _, samples = text.partition(":")
    return int(level), base64.b64decode(samples)


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


# --- documents and their edited texts ------------------------------------------------------

def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str]) -> dict[str, list]:
    """The rows of texts, each with the text that follows it."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    n = len(texts)
    prints = fingerprints([*texts, *changed, *following])
    own, other, after = prints[:n], prints[n : 2 * n], prints[2 * n :]
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        "fingerprint": [shown(p) for p in own],
        "edited_fingerprint": [shown(p) for p in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other)],
        "near_next": [likeness(a, b) for a, b in zip(own, after)],
    }


def _in_line(ids: list, texts: list[str]) -> dict[str, list]:
    """The same for texts that follow each other; the last only follows."""
    n = len(texts) - 1
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    prints = fingerprints([*texts, *changed])
    own, other = prints[: n + 1], prints[n + 1 :]
    return {
        "doc_id": ids[:n],
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
        "fingerprint": [shown(p) for p in own[:n]],
        "edited_fingerprint": [shown(p) for p in other],
        "near_edited": [likeness(a, b) for a, b in zip(own, other)],
        "near_next": [likeness(own[i], own[i + 1]) for i in range(n)],
    }


def next_to_each_other(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    of every row of docs (doc_id, text): its fingerprint and that of its text with the last
    half replaced by the beginning of the next document in descending doc_id, and how like
    they are; the last is followed by the first.

    Null texts are empty ones; an empty text has no samples, is like another empty one by 1
    and like any other by 0. Rows that repeat an id follow each other by the hash of their
    texts; rows without an id come last. A single row is followed by itself. Texts are walked
    whole; one text at a time must fit a task. Extra columns are left out. An empty table gives
    no rows.

    Rows are dealt by ranges of doc_id, once. A task has the successors of all its rows but
    the last, whose text it hands on, as it does its first; those few rows meet in a join.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        first, chars = True, 0

        def edge(kind: int) -> pa.RecordBatch:
            none = {c: pa.nulls(1) for c in _COLUMNS}
            at = 0 if kind == 0 else -1
            return pa.RecordBatch.from_pydict(none | {"doc_id": pa.array([ids[at]], pa.int64()), "part": pa.array([part]), "tail": pa.array([kind == 1]), "text": pa.array([texts[at].encode("utf-8", "replace")], pa.binary())})

        def done() -> pa.RecordBatch:
            d = _in_line(ids, texts)
            none = pa.nulls(len(d["doc_id"]))
            return pa.RecordBatch.from_pydict(d | {"part": none, "tail": none, "text": none})

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(_text(raw.as_py()))
                chars += len(texts[-1])
                if first:
                    yield edge(0).cast(whole)
                    first = False
                if chars >= TOGETHER and len(texts) > 1:
                    yield done().cast(whole)
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield done().cast(whole)
        if texts:
            yield edge(1).cast(whole)

    whole = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _COLUMNS[2:5]), *((c, pa.float64()) for c in _COLUMNS[5:]), ("part", pa.int64()), ("tail", pa.bool_()), ("text", pa.binary())])
    spark = docs.sparkSession
    lined = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        .repartitionByRange(F.desc_nulls_last("doc_id"))
        .sortWithinPartitions(F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    )
    with texts_together(spark):
        found = stored(lined.mapInArrow(read, f"{_SCHEMA}, part long, tail boolean, text binary"))
    edges = found.where("part is not null")
    parts = sorted(r.part for r in edges.where("tail").select("part").collect())  # one a task
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part long, after long")
    pairs = edges.where("tail").select("part", "doc_id", "text").join(F.broadcast(after), "part").join(edges.where("not tail").select(F.col("part").alias("after"), F.col("text").alias("following")), "after")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict(_compared(b.column(0).to_pylist(), *([_text(x) for x in b.column(k).to_pylist()] for k in (1, 2)))).cast(pa.schema(list(whole)[:7]))

    return found.where("part is null").select(*_COLUMNS).unionByName(pairs.select("doc_id", "text", "following").mapInArrow(finish, _SCHEMA))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row of docs; nulls and the rest as above."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_chars": [len(t) for t in texts], "fingerprint": pa.array(map(shown, fingerprints(texts)), pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(read, "doc_id long, n_chars long, fingerprint string")


# --- search ----------------------------------------------------------------------------------

def _bands(prints: pd.Series, above: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, bands that may differ, level and place, samples) at the text's level and, as a
    text of up to twice the length has the next one, ``above`` levels more."""
    for r, p in enumerate(map(parsed, prints)):
        for level in range(p[0], p[0] + above + 1):
            x = thinned(p, level)
            for k in range(-(-max(len(x), 1) // BAND)):
                yield r, len(x), level << 32 | k, x[BAND * k : BAND * (k + 1)].tobytes()


def _banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        got = list(_bands(d["fingerprint"], 1))
        row = [g[0] for g in got]
        yield pd.DataFrame({"fingerprint": d["fingerprint"].to_numpy()[row], "view": [g[2] >> 32 for g in got], "size": [g[1] for g in got], "place": [g[2] for g in got], "band": [g[3] for g in got]})


def search(queries: DataFrame, index: DataFrame, least: float = LEAST) -> DataFrame:
    """(query_id, doc_id, likeness): for each row of queries (doc_id, fingerprint) the rows of
    index whose likeness is ``least`` or more; both as from fingerprinted. least must exceed
    (BAND - 1) / BAND; then no such pair is lost, but for texts of which one has four times
    the other's length or more, which are never so like.

    Equal fingerprints are looked up once. The bands of all queries are counted over the index;
    a query asks for its rarest ones, as many as may differ and one more, so a band that many
    texts share is asked for by texts that consist of such bands alone.
    """
    if not BAND * (1 - least) < 1:
        raise ValueError("bands this wide may miss pairs this unlike")
    asked, there = (stored(x.select("fingerprint").distinct().mapInPandas(_banded, "fingerprint string, view long, size long, place long, band binary")) for x in (queries, index))
    counts = there.groupBy("place", "band").agg(F.count("*").alias("times"))
    ranked = asked.join(counts, ["place", "band"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    # samples that may differ among the larger number of both, whose less part is this one's
    rare = ranked.groupBy("fingerprint", "view", "size").agg(F.array_sort(F.collect_list(F.struct("times", "place", "band"))).alias("b"))
    few_ = F.expr(f"slice(b, 1, int(floor(size / {least} * (1 - {least}) + 1e-9)) + 1)")
    keys = rare.select(F.col("fingerprint").alias("q"), F.explode(few_).alias("b")).select("q", "b.place", "b.band").distinct()
    pairs = keys.join(there.select(F.col("fingerprint").alias("d"), "place", "band"), ["place", "band"]).select("q", "d").distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            yield d.assign(likeness=[likeness(parsed(a), parsed(b)) for a, b in zip(d["q"], d["d"])])

    good = pairs.mapInPandas(verify, "q string, d string, likeness double").where(F.col("likeness") >= least)
    return (
        good.join(queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q")), "q")
        .join(index.select("doc_id", F.col("fingerprint").alias("d")), "d")
        .select("query_id", "doc_id", "likeness")
    )


def op12_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_to_each_other(table(spark, sf_dir, "documents").select("doc_id", "text"))
