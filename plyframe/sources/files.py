"""Readers of stored tables and logs. A packed file is dealt to tasks by byte ranges that
fall on whole words or records, so no task holds a file; headers are checked on the driver.
Files are opened through pyarrow's file systems, by URI or local path."""

from __future__ import annotations

import ast
import bisect
import io
import json
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: records or words that a task reads at a time
CHUNK = 1 << 20


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _open(uri: str):
    store, path = _store(uri)
    return store.open_input_file(path)


def parts_of(uri: str) -> dict | None:
    """What a file in parts says of itself, null for a plain file: a folder with the files
    that make it up, in order, under ``parts`` (name, bytes), see sinks.write_in_order."""
    store, path = _store(uri)
    if store.get_file_info(path).is_file:
        return None
    with store.open_input_file(f"{path}/parts.json") as f:
        return json.loads(f.read())


def _read_plain(uri: str, start: int, length: int) -> bytes:
    with _open(uri) as f:
        f.seek(start)
        return f.read(length)


def read_bytes(uri: str, start: int, length: int) -> bytes:
    """A range of a file, which may be stored in parts."""
    told = parts_of(uri)
    if told is None:
        return _read_plain(uri, start, length)
    out, at = [], 0
    for name, size in told["parts"]:
        lo, hi = max(start, at), min(start + length, at + size)
        if lo < hi:
            out.append(_read_plain(f"{uri}/{name}", lo - at, hi - lo))
        at += size
    return b"".join(out)


def file_size(uri: str) -> int:
    told = parts_of(uri)
    if told is None:
        with _open(uri) as f:
            return f.size()
    return sum(file_size(f"{uri}/{name}") for name, _ in told["parts"])


def _ranges(spark: SparkSession, n: int) -> DataFrame:
    """(id) of the chunks of n items."""
    chunks = max(1, -(-n // CHUNK))
    return spark.range(0, chunks, 1, min(chunks, 10_000))


def read_plane(spark: SparkSession, uri: str, n: int, bits: int = 2, offset: int = 0) -> DataFrame:
    """(rank, code): n values of 1, 2 or 8 bits packed in little-endian words from offset."""
    need = offset + -(-n * bits // 8)
    if file_size(uri) < need:
        raise ValueError(f"{uri} is shorter than its {n} values")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for k in d["id"].tolist():
                lo, hi = k * CHUNK, min(n, (k + 1) * CHUNK)
                raw = np.frombuffer(read_bytes(uri, offset + lo * bits // 8, -(-(hi - lo) * bits // 8)), dtype=np.uint8)
                per = 8 // bits
                code = ((raw[:, None] >> (np.arange(per, dtype=np.uint8) * bits)) & ((1 << bits) - 1)).ravel()[: hi - lo]
                yield pd.DataFrame({"rank": np.arange(lo, hi), "code": code.astype(np.int16)})

    return _ranges(spark, n).mapInPandas(read, "rank long, code short")


def read_records(spark: SparkSession, uri: str, fields: list[tuple[str, str]], n: int | None = None, offset: int = 0) -> DataFrame:
    """(rank, fields...) of fixed records; fields are (name, numpy format). Unsigned 64-bit
    fields keep their bits in a signed LONG, smaller ones their value."""
    kind = np.dtype(fields)
    left = file_size(uri) - offset
    if n is None:
        if left % kind.itemsize:
            raise ValueError(f"{uri} does not end with a whole record")
        n = left // kind.itemsize
    elif left < n * kind.itemsize:
        raise ValueError(f"{uri} is shorter than its {n} records")

    def wide(t: np.dtype) -> np.dtype:
        return np.dtype(np.int64) if t.kind in "iu" else np.dtype(np.float64) if t.kind == "f" else np.dtype(object)

    schema = T.StructType([T.StructField("rank", T.LongType())] + [T.StructField(f, T.LongType() if kind[f].kind in "iu" else T.DoubleType() if kind[f].kind == "f" else T.BinaryType()) for f in kind.names])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for k in d["id"].tolist():
                lo, hi = k * CHUNK, min(n, (k + 1) * CHUNK)
                rows = np.frombuffer(read_bytes(uri, offset + lo * kind.itemsize, (hi - lo) * kind.itemsize), dtype=kind)
                out = {"rank": np.arange(lo, hi)}
                for f in kind.names:
                    v = rows[f]
                    out[f] = v.view(np.int64) if v.dtype == np.uint64 else v.astype(wide(v.dtype)) if v.dtype.kind != "V" else [x.tobytes() for x in v]
                yield pd.DataFrame(out)

    return _ranges(spark, n).mapInPandas(read, schema)


def read_solver_table(spark: SparkSession, uri: str) -> DataFrame:
    """(rank, code, depth) of a table with a value byte plane and a depth plane."""
    magic, w, h, k, n = struct.unpack("<IiiiQ", read_bytes(uri, 0, 24))
    if magic != 0x53484257:
        raise ValueError(f"{uri} is no table of this kind")
    values = read_plane(spark, uri, n, 8, 24)
    depth = read_records(spark, uri, [("depth", "<u2")], n, 24 + n)
    return values.join(depth, "rank")


def read_layer_database(spark: SparkSession, uri: str) -> DataFrame:
    """(ply, w0.., value) of a keyed database with a header of layer counts."""
    magic, version, _w, _h, _sym, _prune, words, layers, total = struct.unpack("<8s7IQ", read_bytes(uri, 0, 44))
    if magic != b"TWIXTDB1" or version != 1 or not words or not layers:
        raise ValueError(f"{uri} is no layer database")
    at = 44 + 8 * words
    counts = struct.unpack(f"<{layers}Q", read_bytes(uri, at, 8 * layers))
    at += 8 * layers
    if sum(counts) != total or file_size(uri) != at + total * (8 * words + 1):
        raise ValueError(f"{uri} has the wrong length")
    rows = read_records(spark, uri, [(f"w{i}", "<u8") for i in range(words)] + [("value", "i1")], total, at)
    edges, ply, seen = [], F.lit(None).cast("int"), 0
    for k, c in enumerate(counts):
        edges.append((seen, k))
        seen += c
    for start, k in edges:
        ply = F.when(F.col("rank") >= start, k).otherwise(ply)
    return rows.withColumn("ply", ply).where(F.when(F.col("value").isin(-1, 0, 1), True).otherwise(F.raise_error(F.lit("a value out of range")).isNull()))


def read_proof_records(spark: SparkSession, uri: str) -> DataFrame:
    """(key, res, best, depth) of a sorted file of proven positions."""
    magic, _w, _h, _suicide, _ko, _t, n = struct.unpack("<8sIIBBhQ", read_bytes(uri, 0, 28))
    if magic != b"MGWDL1\0\0":
        raise ValueError(f"{uri} is no file of proof records")
    rows = read_records(spark, uri, PROOF, n, 28)
    return rows.drop("pad")


def lookup_records(keys: DataFrame, uri: str, fields: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """The records of a file in parts whose fields ``order`` are among the keys, each key once;
    missing ones have no row. Columns are those of fields without padding.

    Keys are dealt by ranges and sorted, so a task goes through its parts from front to end:
    the first keys of the parts lead to a part, the part's sparse directory to a block, of
    which one range is read; within it the key is bisected.
    """
    kind, told = np.dtype(fields), parts_of(uri)
    block, parts = told["block"], [p for p in told["parts"] if p[0] in told["first"]]
    firsts = [tuple(told["first"][name]) for name, _ in parts]
    names = [n for n, f in fields if not f.startswith("V")]
    plain = lambda x: np.asarray(x).astype(np.int64).view(np.uint64).tolist()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_part = at_block = None
        directory: list[tuple] = []
        inside: list[tuple] = []
        rows = np.zeros(0, dtype=kind)
        for d in batches:
            hits = []
            for key in zip(*(plain(d[c]) for c in order)):
                p = bisect.bisect_right(firsts, key) - 1
                if p < 0:
                    continue
                if p != at_part:
                    name, size = parts[p]
                    with _open(f"{uri}/keys-{name}") as f:
                        raw = np.frombuffer(f.read(), dtype="<u8").reshape(-1, len(order))
                    directory, at_part, at_block = list(map(tuple, raw.tolist())), p, None
                b = bisect.bisect_right(directory, key) - 1
                if b != at_block:
                    rows = np.frombuffer(_read_plain(f"{uri}/{name}", b * block * kind.itemsize, block * kind.itemsize), dtype=kind)
                    inside, at_block = list(zip(*(rows[c].tolist() for c in order))), b
                i = bisect.bisect_left(inside, key)
                if i < len(inside) and inside[i] == key:
                    hits.append(rows[i : i + 1])
            if hits:
                found = np.concatenate(hits)
                yield pd.DataFrame({n: found[n].view(np.int64) if found[n].dtype == np.uint64 else found[n].astype(np.int64) for n in names})

    unsigned = [F.col(c).cast("long").bitwiseXOR(F.lit(-(1 << 63))) for c in order]
    dealt = keys.select(*(F.col(c).cast("long").alias(c) for c in order)).na.drop().distinct().repartitionByRange(*unsigned).sortWithinPartitions(*unsigned)
    return dealt.mapInPandas(find, ", ".join(f"`{n}` long" for n in names))


PROOF = [("key", "<u8"), ("res", "u1"), ("best", "u1"), ("depth", "u1"), ("pad", "V5")]


def read_position_dump(spark: SparkSession, uri: str) -> DataFrame:
    """(lo, hi, status): records of a 128-bit position and a status byte."""
    return read_records(spark, uri, [("lo", "<u8"), ("hi", "<u8"), ("status", "u1")])


def read_value_dump(spark: SparkSession, uri: str, m: int, p: int) -> DataFrame:
    """(rank, code) of a dump with four 64-bit header words and a byte a state."""
    magic, gm, gp, n = struct.unpack("<4Q", read_bytes(uri, 0, 32))
    if (magic, gm, gp) != (0xCCB0F0CE, m, p):
        raise ValueError(f"{uri} is no dump of this board")
    return read_plane(spark, uri, n, 8, 32)


#: fixed value: the digits of the bounds tablebase, from 0 on; a bound is its digit less 36
DIGITS = "56789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#_"


def read_bounds(spark: SparkSession, uri: str) -> DataFrame:
    """(mover, other, kind, lower, upper) of 13-byte text records: nine base-81 digits of four
    ternary cells each, a kind, two bounds and a line feed."""
    rows = read_records(spark, uri, [("key", "V9"), ("kind", "V1"), ("lower", "V1"), ("upper", "V1"), ("end", "V1")])
    text = rows.select("rank", *[F.decode(c, "US-ASCII").alias(c) for c in ("key", "kind", "lower", "upper")])
    mover = other = F.lit(0).cast("long")
    for i in range(9):
        v = F.expr(f"instr('{DIGITS}', substr(key, {i + 1}, 1)) - 1")
        for j in range(4):
            d = F.pmod(F.floor(v / 3**j), F.lit(3))
            mover = mover + F.when(d == 1, F.lit(1 << (4 * i + j))).otherwise(0)
            other = other + F.when(d == 2, F.lit(1 << (4 * i + j))).otherwise(0)
    at = lambda c: F.expr(f"instr('{DIGITS}', {c}) - 1")
    return text.select("rank", mover.alias("mover"), other.alias("other"), at("kind").alias("kind"), (at("lower") - 36).alias("lower"), (at("upper") - 36).alias("upper"))


def read_npy(spark: SparkSession, uri: str) -> DataFrame:
    """(rank, c0, c1, ...) of a two-dimensional array of unsigned words."""
    head = io.BytesIO(read_bytes(uri, 0, min(4096, file_size(uri))))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
    if fortran or len(shape) != 2:
        raise ValueError(f"{uri} is not in rows")
    return read_records(spark, uri, [(f"c{i}", kind.str) for i in range(shape[1])], shape[0], head.tell())


def read_blocks(spark: SparkSession, uri: str) -> DataFrame:
    """(section, block, data) of a file of compressed blocks; only complete sections, every
    block checked against its checksum."""
    magic, version, _slice, sections, _written = struct.unpack("<8sIIQQ", read_bytes(uri, 0, 32))
    if magic != b"PGSLICE1" or version != 1:
        raise ValueError(f"{uri} is no file of blocks")
    table = read_bytes(uri, 64, 48 * sections)
    todo = []
    for i in range(sections):
        _sig, a, b, c, d, off, length, flags, _ = struct.unpack_from("<Q4iQQII", table, 48 * i)
        blocks = 1
        for x in (a, b, c, d):
            blocks *= -(-x // 8)
        if flags & 1:
            todo.append((i, off, length, blocks))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for i, off, _length, blocks in d.itertuples(index=False):
                entries = read_bytes(uri, off, 24 * blocks)
                for k in range(blocks):
                    at, packed, size, crc, _ = struct.unpack_from("<QIIII", entries, 24 * k)
                    data = zlib.decompress(read_bytes(uri, off + 24 * blocks + at, packed))
                    if len(data) != size or zlib.crc32(data) != crc:
                        raise ValueError(f"block {k} of section {i} is damaged")
                    yield pd.DataFrame({"section": [i], "block": [k], "data": [data]})

    start = spark.createDataFrame(todo, "section long, off long, length long, blocks long")
    return start.repartition(max(1, min(len(todo), 1000))).mapInPandas(read, "section long, block long, data binary")


def read_calibration(spark: SparkSession, uri: str) -> DataFrame:
    """Rows of a tab-separated result table with a header; rows without a result or with
    fewer than six columns are dropped."""
    kinds = "empties int, side string, book_wl double, book_ssM double, result string, nodes long, seconds double, board string"
    return spark.read.csv(uri, sep="\t", header=True, schema=kinds).where("result is not null and nodes is not null")


def read_game_logs(spark: SparkSession, uri: str, lines: bool = False) -> DataFrame:
    """(file, winner, n, board, turn, passive, aggressive): one row a turn of JSON logs with
    ordered turns and a board before each; a game a file, or a line."""
    step = "struct<origin: struct<x: int, y: int>, heading: struct<x: int, y: int>>"
    kinds = f"game_states array<struct<board: string, turn: string>>, turns array<struct<passive: {step}, aggressive: {step}>>, winner string"
    games = spark.read.schema(kinds).json(uri, multiLine=not lines).withColumn("file", F.input_file_name())
    return games.select("file", "winner", F.posexplode(F.arrays_zip("game_states", "turns")).alias("n", "z")).where("z.turns is not null").select("file", "winner", "n", "z.game_states.board", "z.game_states.turn", "z.turns.passive", "z.turns.aggressive")


_BOARD, _NEXT, _MOVES = (re.compile(p) for p in (r"const board = \[([0-9,]+)\]", r"const nextPla = (\d)", r"const moves = (\[.*\])"))


def book_row(page: str):
    """(board, next, best_wl, best_ss, visits, n_moves) of a book page, or None."""
    board, side, moves = _BOARD.search(page), _NEXT.search(page), _MOVES.search(page)
    if not board or not side:
        return None
    cells = "".join(".XO"[int(c)] for c in board[1].split(",") if c)[:49]
    best, n = {}, 0
    if moves:
        try:
            found = ast.literal_eval(re.sub(r",\s*([\]}])", r"\1", moves[1]))
            n, best = len(found), max(found, key=lambda m: m.get("v", 0), default={})
        except (ValueError, SyntaxError):
            pass
    return cells, "b" if side[1] == "1" else "w", best.get("wl"), best.get("ssM"), best.get("v", 0), n


def read_book_archive(spark: SparkSession, uri: str) -> DataFrame:
    """Rows of every page in gzipped tar archives of book pages; an archive is one task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["board", "next", "best_wl", "best_ss", "visits", "n_moves"]
        for d in batches:
            for content in d["content"]:
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
                    for member in archive:
                        if member.isfile() and member.name.endswith(".html"):
                            row = book_row(archive.extractfile(member).read().decode("utf-8", "replace"))
                            rows += [row] if row else []
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(uri).select("content")
    return files.mapInPandas(read, "board string, next string, best_wl double, best_ss double, visits long, n_moves int")


def read_layers(spark: SparkSession, path: str, layers: list[int], by: str = "layer") -> DataFrame:
    """Rows of some layers of a table written by layer; folders of others are not opened."""
    return spark.read.parquet(path).where(F.col(by).isin(layers))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(section, block, data) of the sections written by write_sections, each block checked
    against its checksum."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for name, content in zip(d["path"], d["content"]):
                section = int(re.search(r"section-(\d+)\.z$", name)[1])
                (blocks,) = struct.unpack_from("<Q", content)
                at = 8 + 20 * blocks
                for k in range(blocks):
                    block, packed, size, crc = struct.unpack_from("<QIII", content, 8 + 20 * k)
                    data = zlib.decompress(content[at : at + packed])
                    if len(data) != size or zlib.crc32(data) != crc:
                        raise ValueError(f"block {block} of section {section} is damaged")
                    yield pd.DataFrame({"section": [section], "block": [block], "data": [data]})
                    at += packed

    files = spark.read.format("binaryFile").option("pathGlobFilter", "section-*.z").load(path).select("path", "content")
    return files.mapInPandas(read, "section long, block long, data binary")
