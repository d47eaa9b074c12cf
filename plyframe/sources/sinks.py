"""Writers. Tables go to parquet by layer, whose commit protocol stands for a temporary file
and a rename. A packed file is stored in parts: each task writes its own range of it, and the
driver only learns the sizes, whose prefix sums are the places of the ranges."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyframe.persist import cut
from plyframe.sources.files import CHUNK, DIGITS, PROOF

#: records between two entries of a part's directory
BLOCK = 4096


def _put(uri: str, parts: Iterable[bytes]) -> None:
    """Write beside the name, then move there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    store.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    spare = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(spare) as out:
        for x in parts:
            out.write(x)
    store.move(spare, path)


def write_in_order(df: DataFrame, uri: str, order: list, pack, header=lambda n: b"", block: int = BLOCK, parts: int | None = None) -> None:
    """Writes the rows in an order as one file in parts: a folder of a header, a part for each
    range of rows, and a sparse directory beside each part. ``order`` are the columns to sort
    by; pack gives for a frame of rows their bytes, and their keys as an array of unsigned
    words, one row a record, or None where there is no directory. header gives the first
    bytes for the number of rows. Without ``parts`` Spark decides how many there are.

    parts.json comes last and makes the file: until then nothing of it is read. A task that
    is tried again writes the same part again. Rows are dealt once; nothing goes through the
    driver but a row a task.
    """
    ranges = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    dealt = cut(ranges.sortWithinPartitions(*order))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():06d}"
        rows, size, first, directory = 0, 0, None, []

        def body():
            nonlocal rows, size, first
            for d in batches:
                if not len(d):
                    continue
                data, keys = pack(d)
                if keys is not None:
                    first = keys[0].tolist() if first is None else first
                    directory.append(keys[-rows % block :: block])
                rows += len(d)
                size += len(data)
                yield data

        _put(f"{uri}/{name}", body())
        if first is not None:
            _put(f"{uri}/keys-{name}", [np.concatenate(directory).astype("<u8").tobytes()])
        yield pd.DataFrame({"name": [name], "rows": [rows], "size": [size], "first": [json.dumps(first)]})

    done = sorted(dealt.mapInPandas(write, "name string, rows long, size long, first string").collect())  # a row a task
    head = header(sum(r.rows for r in done))
    _put(f"{uri}/header", [head])
    told = {"parts": [["header", len(head)], *([r.name, r.size] for r in done if r.size)], "first": {r.name: json.loads(r.first) for r in done if r.size and r.first != "null"}, "block": block}
    _put(f"{uri}/parts.json", [json.dumps(told).encode()])


def write_layers(df: DataFrame, path: str, by: str = "layer", key: str = "id") -> None:
    """One folder a layer, sorted by key inside files; writing a layer again replaces that
    layer only, so an interrupted solve goes on from the layers that are there."""
    df.repartitionByRange(by, key).sortWithinPartitions(by, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_plane(df: DataFrame, uri: str, n: int, bits: int = 2, header: bytes = b"") -> None:
    """(rank, code) as n values of 1, 2 or 8 bits; ranks that are missing are 0."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, codes = None, None

        def done():
            used = min(CHUNK, n - chunk * CHUNK)
            per = 8 // bits
            c = np.zeros(-(-used // per) * per, dtype=np.uint8)
            c[:used] = codes[:used]
            out = np.bitwise_or.reduce(c.reshape(-1, per) << (np.arange(per, dtype=np.uint8) * bits), axis=1).astype(np.uint8)
            return pd.DataFrame({"chunk": [chunk], "data": [out.tobytes()]})

        for d in batches:
            for k, rows in d.groupby(d["rank"] // CHUNK, sort=False):
                if k != chunk:
                    if chunk is not None:
                        yield done()
                    chunk, codes = int(k), np.zeros(CHUNK, dtype=np.uint8)
                codes[(rows["rank"] - chunk * CHUNK).to_numpy()] = rows["code"].to_numpy()
        if chunk is not None:
            yield done()

    rows = df.where(F.col("rank").between(0, n - 1)).select("rank", "code", F.floor(F.col("rank") / CHUNK).alias("chunk"))
    packed = rows.repartition("chunk").sortWithinPartitions("rank").select("rank", "code").mapInPandas(pack, "chunk long, data binary")
    every = df.sparkSession.range(-(-n // CHUNK)).select(F.col("id").alias("chunk")).join(packed, "chunk", "left")

    def whole(d: pd.DataFrame) -> tuple[bytes, None]:
        size = lambda k: -(-min(CHUNK, n - k * CHUNK) * bits // 8)
        return b"".join(bytes(size(k)) if x is None else x for k, x in zip(d["chunk"].tolist(), d["data"])), None

    write_in_order(every, uri, ["chunk"], whole, lambda _: header)


def _unsigned(column: str):
    return F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def _words(d: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.stack([d[c].to_numpy(dtype=np.int64).view(np.uint64) for c in columns], axis=1)


def write_proof_records(df: DataFrame, uri: str, w: int, h: int, threshold: int, superko: bool = True, suicide: bool = False) -> None:
    """(key, res, best, depth) as sorted 16-byte records; keys compare as unsigned."""

    def pack(d: pd.DataFrame):
        out = np.zeros(len(d), dtype=PROOF)
        keys = _words(d, ["key"])
        out["key"] = keys[:, 0]
        for c in ("res", "best", "depth"):
            out[c] = d[c]
        return out.tobytes(), keys

    write_in_order(df.select("key", "res", "best", "depth"), uri, [_unsigned("key")], pack, lambda n: struct.pack("<8sIIBBhQ", b"MGWDL1\0\0", w, h, suicide, superko, threshold, n))


def write_layer_database(df: DataFrame, uri: str, w: int, h: int, root: list[int], symmetry: bool = False, pruning: bool = False) -> None:
    """(ply, w0.., value) with a header of layer counts; keys compare as unsigned words."""
    names = [f"w{i}" for i in range(len(root))]
    counts = {r.ply: r["count"] for r in df.groupBy("ply").count().collect()}  # one row a layer
    layers = max(counts, default=-1) + 1
    kind = np.dtype([*((c, "<u8") for c in names), ("value", "i1")])

    def pack(d: pd.DataFrame):
        out = np.zeros(len(d), dtype=kind)
        keys = _words(d, ["ply", *names])
        for i, c in enumerate(names):
            out[c] = keys[:, i + 1]
        out["value"] = d["value"]
        return out.tobytes(), keys

    def header(n: int) -> bytes:
        fixed = struct.pack("<8s7IQ", b"TWIXTDB1", 1, w, h, symmetry, pruning, len(root), layers, n)
        return fixed + struct.pack(f"<{len(root)}q", *root) + struct.pack(f"<{layers}Q", *[counts.get(k, 0) for k in range(layers)])

    write_in_order(df.select("ply", *names, "value"), uri, ["ply", *map(_unsigned, names)], pack, header)


def write_bounds(df: DataFrame, uri: str, order: str) -> None:
    """(mover, other, kind, lower, upper) as 13-byte text records, which files.read_bounds
    reads, in the order of a column: boards of 36 cells, kinds from 0, bounds from -36."""
    letters = np.frombuffer(DIGITS.encode(), dtype=np.uint8)

    def pack(d: pd.DataFrame) -> tuple[bytes, None]:
        out = np.full((len(d), 13), 10, dtype=np.uint8)
        mover, other = d["mover"].to_numpy(), d["other"].to_numpy()
        for i in range(9):
            digit = sum(3**j * ((mover >> (4 * i + j) & 1) + 2 * (other >> (4 * i + j) & 1)) for j in range(4))
            out[:, i] = letters[digit]
        for i, c in enumerate((d["kind"], d["lower"] + 36, d["upper"] + 36)):
            out[:, 9 + i] = letters[c.to_numpy()]
        return out.tobytes(), None

    write_in_order(df.select(order, "mover", "other", "kind", "lower", "upper"), uri, [order], pack)


def write_verdict_text(df: DataFrame, path: str) -> None:
    """(a, b, x, value) as lines of hexadecimal boards and W, L or D."""
    verdict = F.when(F.col("value") == 1, "W").when(F.col("value") == -1, "L").otherwise("D")
    df.select(F.concat_ws(" ", F.lower(F.hex("a")), F.lower(F.hex("b")), F.lower(F.hex("x")), verdict).alias("value")).write.mode("overwrite").text(path)


def add_reach(values: DataFrame, reached: DataFrame) -> DataFrame:
    """values with reachable; the plane that is added to a finished table."""
    return values.join(reached.select("id", F.lit(True).alias("_r")), "id", "left").withColumn("reachable", F.coalesce("_r", F.lit(False))).drop("_r")


def mask_unreached(values: DataFrame, reached: DataFrame) -> DataFrame:
    """values with null where a state is not reached."""
    flagged = add_reach(values, reached)
    return flagged.withColumn("value", F.when(F.col("reachable"), F.col("value"))).drop("reachable")


def write_summary(df: DataFrame, uri: str) -> None:
    """A short table as a JSON file: tallies, histories, goldens."""
    _put(uri, [json.dumps([r.asDict(recursive=True) for r in df.collect()], default=str).encode()])


def manifest(spark, path: str) -> DataFrame:
    """(line): checksum and name of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.concat(F.sha2("content", 256), F.lit("  "), F.element_at(F.split("path", "/"), -1)).alias("line"))


def sections_done(spark, path: str) -> set[int]:
    """The sections that are whole: files get their names when they are."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    names = [x.base_name for x in store.get_file_info(fs.FileSelector(at, allow_not_found=True))]
    return {int(x[8:-2]) for x in names if x.startswith("section-") and x.endswith(".z")}


def write_sections(df: DataFrame, path: str) -> DataFrame:
    """Compress (section, block, data) into one file a section below path; gives (section,
    blocks, bytes) of those that were written. The restart cursor is the set of sections that
    are there: an interrupted run goes on with the others. A section is one task's, a block
    is held in memory, and a file is named when it is whole."""
    done = sorted(sections_done(df.sparkSession, path))
    todo = df.where(~F.col("section").isin(done)) if done else df

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        section, table, body = None, [], []

        def close():
            _put(f"{path}/section-{section:08d}.z", [struct.pack("<Q", len(table)), *(struct.pack("<QIII", *t) for t in table), *body])
            return pd.DataFrame({"section": [section], "blocks": [len(table)], "bytes": [sum(map(len, body))]})

        for d in batches:
            for s, block, data in zip(d["section"].tolist(), d["block"].tolist(), d["data"]):
                if s != section:
                    if section is not None:
                        yield close()
                    section, table, body = s, [], []
                packed = zlib.compress(data)
                table.append((block, len(packed), len(data), zlib.crc32(data)))
                body.append(packed)
        if section is not None:
            yield close()

    rows = todo.select("section", "block", "data").repartition("section").sortWithinPartitions("section", "block")
    return rows.mapInPandas(pack, "section long, blocks long, bytes long")
