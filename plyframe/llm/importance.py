"""Resampling of documents towards a target: hashed features, array-scored weights, and an
exact draw by a tournament of sorted runs.

Texts are read once: a document becomes an array of feature buckets, which the counts and the
weights are taken from. The draw needs the first share of all documents in one order. Scores
are cut into ranges at approximate quantiles and counted exactly, which gives each range the
rank that it begins with and ends the work at the range that holds the last draw. Each
partition writes its eligible rows above that as a sorted run into the shared folder; a task
merges one range of all runs through tournament trees, row group by row group, and stops at
the exact count. More runs than a tree takes are merged into longer ones first. The drawn
rows are those up to the last drawn key, so nothing is joined back.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import LOWER, cut, shared_dir, stored, table, texts_together
from plyframe.persist import written

N_BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: draws that one task merges, about; more ranges than ``RANGES`` are not made
DRAWS, RANGES = 1 << 16, 4096
#: runs that a task merges at once
FAN = 128
#: bytes of a word that are hashed for all words together; the rest of longer ones by itself
TOGETHER = 64

_WORD = np.array([not (b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of every stretch data[start:end], a byte of all stretches at a time."""
    size = np.minimum(end - start, TOGETHER + 1).astype(np.uint16)
    order = np.argsort(size, kind="stable")[::-1]
    at, size = start[order], size[order]
    c = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    left = np.searchsorted(-size.astype(np.int32), -np.arange(TOGETHER + 1))  # stretches longer than so many bytes
    for p in range(TOGETHER):
        if not (n := left[p]):
            break
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + p]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(end - start > TOGETHER):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes())
    return out


def feature_buckets(texts: list[bytes], longest: int = 1, n_buckets: int = N_BUCKETS) -> list[bytes]:
    """For each text the buckets of its features as packed uint32: all runs of 1 to
    ``longest`` consecutive words, joined by one space."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), dtype=np.uint8)
    stop = np.cumsum([len(t) + 1 for t in texts])
    flag = np.zeros(len(data) + 1, dtype=np.int8)
    flag[1:] = _WORD[data]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = np.searchsorted(stop, start, side="right")
    if longest > 1:  # words with one space after each, so that a run is a stretch
        keep = flag[1:].astype(bool)
        keep[end] = True
        place = np.cumsum(keep) - 1
        data = np.where(flag[1:].astype(bool), data, np.uint8(32))[keep]
        start, end = place[start], place[end]
    found, whose = [], []
    for n in range(1, longest + 1):
        m = max(len(start) - n + 1, 0)
        one = owner[:m] == owner[n - 1 : n - 1 + m]
        found.append(crc32(data, start[:m][one], end[n - 1 : n - 1 + m][one]) % np.uint32(n_buckets))
        whose.append(owner[:m][one])
    found, whose = np.concatenate(found), np.concatenate(whose)
    if longest > 1:
        order = np.argsort(whose, kind="stable")
        found, whose = found[order], whose[order]
    bound = np.searchsorted(whose, np.arange(len(texts) + 1))
    return [found[bound[i] : bound[i + 1]].astype("<u4").tobytes() for i in range(len(texts))]


def featured(rows: DataFrame, longest: int = 1, n_buckets: int = N_BUCKETS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, uid, enough, buckets): a stored table of the rows' features; enough says whether
    a text has ``least_words`` words. rows are (doc_id, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            got = feature_buckets(texts, longest, n_buckets)
            words = got if longest == 1 else feature_buckets(texts, 1, n_buckets)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "uid": b.column(1), "enough": [len(w) // 4 >= least_words for w in words], "buckets": pa.array(got, pa.binary())})

    spark = rows.sparkSession
    given = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), F.col("text").cast("binary").alias("text"))
    with texts_together(spark):
        return stored(given.mapInArrow(read, "doc_id long, uid long, enough boolean, buckets binary"))


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum([0, *(len(p) // 4 for p in parts)])


def bucket_counts(features: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, k): how many features each bucket holds, added up in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for b in batches:
            total += np.bincount(_joined(b.column(0))[0], minlength=n_buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "k": total[at]})

    return features.select("buckets").mapInArrow(count, "bucket long, k long").groupBy("bucket").agg(F.sum("k").alias("k"))


def bucket_gains(source: DataFrame, target: DataFrame, n_buckets: int) -> np.ndarray:
    """Of each bucket floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))): ``n_buckets`` numbers."""
    spark = source.sparkSession
    s, t = (cut(bucket_counts(x, n_buckets)) for x in (source, target))
    all_s, all_t = (x.agg(F.sum("k")).first()[0] or 0 for x in (s, t))
    k = lambda c, more: F.coalesce(c, F.lit(0)).cast("double") + float(more)
    both = spark.range(n_buckets).withColumnRenamed("id", "bucket").join(s.withColumnRenamed("k", "s"), "bucket", "left").join(t.withColumnRenamed("k", "t"), "bucket", "left")
    gain = F.floor(1000 * F.log(k(F.col("t"), 1) * float(all_s + n_buckets) / (k(F.col("s"), 1) * float(all_t + n_buckets))))
    out = np.zeros(n_buckets, dtype=np.int64)
    for r in both.select("bucket", gain.cast("long").alias("gain")).collect():  # one row a bucket
        out[r.bucket] = r.gain
    return out


def gumbel(seed: int) -> Column:
    """A document's draw of noise, by its id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(features: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, uid, enough, n_features, weight, score), stored."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, bound = _joined(b.column(3))
            total = np.concatenate([[0], np.cumsum(gains[found])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(bound)), pa.array(np.diff(total[bound]))], ["doc_id", "uid", "enough", "n_features", "weight"])

    out = features.mapInArrow(weigh, "doc_id long, uid long, enough boolean, n_features long, weight long")
    return stored(out.withColumn("score", F.col("weight") + gumbel(seed)))


# --- the draw ----------------------------------------------------------------------------

_END = (math.inf,)


def tournament(runs: Iterable[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of tuples: an inner node of the tree keeps the loser of its match,
    so a row costs one match a level. Memory holds one row of each run and what the runs
    hold themselves."""
    runs = list(runs)
    k = len(runs)
    if not k:
        return
    head = [next(r, _END) for r in runs]
    winner, loser = [*[0] * k, *range(k)], [0] * k
    for n in range(k - 1, 0, -1):
        a, b = winner[2 * n], winner[2 * n + 1]
        winner[n], loser[n] = (b, a) if head[b] < head[a] else (a, b)
    top = winner[1] if k > 1 else 0
    while head[top] is not _END:
        yield head[top]
        head[top] = next(runs[top], _END)
        n = (top + k) >> 1
        while n:
            if head[loser[n]] < head[top]:
                loser[n], top = top, loser[n]
            n >>= 1


_ROW = ["score", "doc_id", "uid", "n_features", "weight"]


def run_rows(uri: str, low: int | None = None, high: int | None = None) -> Iterator[tuple]:
    """The rows of a sorted run with low <= score < high, as tuples in the order of the draw.
    Row groups that hold none are not read; one is held at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for g in range(file.num_row_groups):
            seen = file.metadata.row_group(g).column(0).statistics
            if seen is not None and seen.has_min_max and ((low is not None and seen.max < low) or (high is not None and seen.min >= high)):
                continue
            for b in file.iter_batches(4096, row_groups=[g], columns=_ROW):
                for score, doc_id, *rest in zip(*(c.to_pylist() for c in b.columns)):
                    if (low is None or score >= low) and (high is None or score < high):
                        yield (-score, doc_id is None, doc_id or 0, *rest)


def _batches(rows: Iterator[tuple], base: int | None) -> Iterator[pa.RecordBatch]:
    """Merged rows as columns again, with their ranks from base + 1."""
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        nonlocal base
        minus, none, ids, uid, n, weight = (list(c) for c in zip(*held))
        d = {"score": [-x for x in minus], "doc_id": [None if z else i for z, i in zip(none, ids)], "uid": uid, "n_features": n, "weight": weight}
        if base is not None:
            d["rank"] = list(range(base + 1, base + len(held) + 1))
            base += len(held)
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in d.items()})

    for row in rows:
        held.append(row)
        if len(held) == 8192:
            yield out()
            held = []
    if held:
        yield out()


def _write_runs(df: DataFrame) -> list[str]:
    """The files of df, whose partitions are sorted: each is a run."""
    folder = f"{shared_dir(df.sparkSession)}/runs-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 1 << 20).parquet(folder)
    written(df.sparkSession, folder)
    return sorted(df.sparkSession.read.schema(df.schema).parquet(folder).inputFiles())


_SCHEMA = "score long, doc_id long, uid long, n_features long, weight long"


def drawn(rows: DataFrame, draw: int) -> DataFrame:
    """(score, doc_id, uid, n_features, weight, rank) of the first ``draw`` of the rows by score
    from above, then doc_id from below, nulls last, then uid; stored."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, min(RANGES, -(-draw // DRAWS)))
    # scores that about k / parts of the draws are at or above
    shares = [1 - min(1.0, draw / max(n, 1) * k / parts) for k in range(1, parts + 1)]
    bounds = rows.agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), 10_000)).first()[0] if n else []
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(bounds, b.column(0).to_numpy(), side="right"), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"range": np.arange(len(total)), "k": total})

    sizes = {r[0]: r[1] for r in rows.select("score").mapInArrow(count, "range long, k long").groupBy("range").agg(F.sum("k")).collect()}  # at most RANGES + 1 rows
    plan, base = [], 0  # (low, high, rank before, rows to take), from the highest range down
    for r in range(len(bounds), -1, -1):
        if base >= draw:
            break
        low, high = int(bounds[r - 1]) if r else None, int(bounds[r]) if r < len(bounds) else None
        plan.append((low, high, base, min(sizes.get(r, 0), draw - base)))
        base += sizes.get(r, 0)
    above = rows if not plan or plan[-1][0] is None else rows.where(F.col("score") >= plan[-1][0])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("uid")]
    files = _write_runs(above.select(*_ROW).sortWithinPartitions(*order)) if plan else []
    while len(files) > FAN:
        groups = [files[i : i + FAN] for i in range(0, len(files), FAN)]

        def merge(batches: Iterator[pa.RecordBatch], groups=groups) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for g in b.column(0).to_pylist():
                    yield from _batches(tournament(run_rows(f) for f in groups[g]), None)

        files = _write_runs(spark.range(0, len(groups), 1, len(groups)).mapInArrow(merge, _SCHEMA))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                low, high, before, take = plan[r]
                yield from _batches(itertools.islice(tournament(run_rows(f, low, high) for f in files), take), before)

    return stored(spark.range(0, len(plan), 1, max(1, len(plan))).mapInArrow(rank, _SCHEMA + ", rank long"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n_buckets: int = N_BUCKETS, longest: int = 1
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), rank null
    where it is not among the draws: floor(percent * N / 100) of the N texts with
    ``least_words`` words or more. target is a table with a column text.

    Null and empty texts have no words, weight 0 and are not drawn. Texts are read whole, in
    one pass. Rows that repeat an id are documents of their own with the same noise; equal
    scores go by the smaller id, a null id (which draws its noise as an empty one) last, then
    by place in the table. Extra columns are left out. An empty table gives no rows; an empty
    target makes every gain follow the source alone.
    """
    source = featured(docs, longest, n_buckets, least_words)
    aim = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, n_buckets)
    rows = scored(source, bucket_gains(source, aim, n_buckets), seed)
    able = rows.where("enough")
    first = drawn(able, able.count() * percent // 100)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    last = first.orderBy(F.desc("rank")).select("score", "doc_id", "uid").first()
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*out)
    key = lambda score, none, i, uid: F.struct(score.alias("a"), none.alias("b"), i.alias("c"), uid.alias("d"))
    mine = key(-F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("uid"))
    end = key(F.lit(-last.score).cast("long"), F.lit(last.doc_id is None), F.lit(last.doc_id or 0).cast("long"), F.lit(last.uid).cast("long"))
    rest = rows.where(~(F.col("enough") & (mine <= end))).withColumn("rank", F.lit(None).cast("long"))
    return first.select(*out).unionByName(rest.select(*out))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: the checksum's table and its bytes are worked out for each distinct word
OP13_SQL = rf"""
with recursive dw as (select doc_id, {_WORDS} as w from documents),
bw as (select unnest({_WORDS}) as word from benchmark),
df as (select doc_id, unnest(w) as word from dw),
bits(n, c, k) as (select i, i, 0 from generate_series(0, 255) t(i) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
tab as (select list(c order by n) as t from bits where k = 8),
words as (select word, hex(word) as x from (select word from df union select word from bw)),
crc as (select word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as int), 2) as bigint))),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket from words, tab),
s as (select bucket, count(*) as s from df join crc using (word) group by bucket),
t as (select bucket, count(*) as t from bw join crc using (word) group by bucket),
tot as (select (select count(*) from df) as ns, (select count(*) from bw) as nt),
gain as (select b as bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (ns + 10000) / ((coalesce(s, 0) + 1)::double * (nt + 10000)))) as bigint) as g
         from generate_series(0, 9999) u(b) left join s on s.bucket = b left join t on t.bucket = b, tot),
wt as (select doc_id, sum(g)::bigint as weight from df join crc using (word) join gain using (bucket) group by doc_id),
sc as (select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
       coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
       from dw left join wt using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as k from sc where n_features >= 20),
n as (select count(*) * 10 // 100 as draw from r)
select doc_id, n_features, weight, score, case when k <= draw then k end as rank from sc left join r using (doc_id), n
"""
