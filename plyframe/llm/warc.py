"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, one per record, in the order of
digest, id and URL and under a name made from its partition number, so a retried task writes
the same bytes under the same name.
Equal payloads are stored once: the capture with the smallest id is a response, the
others are revisits that refer to it.

Index: one line per record, keyed by the reversed-host form of its URL. Lines are range
partitioned and sorted and packed into zlib blocks of ``BLOCK_LINES`` lines, and a sparse
directory keeps each block's first key and place. A lookup searches the directory by
bisection, inflates one block, searches it by bisection and gives the record's file,
offset and length. Lookups come sorted, so a task opens each block once; the records
found are then read by range in file order.

Files go to the folder in ``spark.checkpoint.dir`` through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import cut, few, shared_dir, table

BLOCK_LINES = 512
MIN_REVISIT_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
SEPARATOR = "\x1f"


def reversed_host(url: str | None) -> str:
    """``com,example,www)/path?query`` with scheme, port and case of the host removed."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else f"http://{text}")
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return text
    rest = parts.path or "/"
    return ",".join(reversed(host.split("."))) + ")" + rest + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value) -> str:
    return json.dumps("" if value is None else str(value))[1:-1]


def record(page_id, url, kind: str, refers_to, payload: bytes, digest: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose length is that of the
    payload, and leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record, its digest checked against a payload that is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    if len(block) != int(field["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload and digest differ")
    name = lambda x: int(v) if (v := x.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": name(field["WARC-Record-ID"]),
        "url": json.loads(f'"{field["WARC-Target-URI"]}"'),
        "record_type": kind,
        "refers_to": name(field["WARC-Refers-To"]) if "WARC-Refers-To" in field else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload,
    }


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, parts: Iterator[bytes]) -> None:
    """Write beside the name and move there, so a reader or a second attempt of the task
    never meets half a file."""
    store, path = _store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    spare = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(spare) as out:
            for x in parts:
                out.write(x)
        store.move(spare, path)
    except BaseException:
        if store.get_file_info(spare).is_file:
            store.delete_file(spare)
        raise


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of (page_id, url, html) as a record below ``folder``; give the
    capture lines (key, file, start, length).

    Null html is an empty payload, a null url an empty one; rows that repeat an id are
    records of their own, and each of those with the smallest id is a response. A row without
    an id is a response unless another row with an id has the payload. A very long page is one
    record, held in memory while it is packed. Extra columns are left out. An empty table
    writes nothing. Only digests that occur twice are joined; payloads are shuffled where
    there are too many of those to broadcast.
    """
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn(
        "sha", F.unhex(F.sha1("payload"))
    )
    first = body.where(f"octet_length(payload) >= {MIN_REVISIT_BYTES}").groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = cut(first.where("n > 1").select("sha", "first"))
    # in one order, so that a second attempt of a task writes the same bytes
    ready = body.join(few(first, "4"), "sha", "left").sortWithinPartitions("sha", "page_id", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():05d}.warc.gz"
        lines: list[tuple] = []

        def members():
            at = 0
            for d in batches:
                for page, url, payload, sha, low in zip(d["page_id"], d["url"], d["payload"], d["sha"], d["first"]):
                    page = None if pd.isna(page) else int(page)
                    low = None if pd.isna(low) else int(low)
                    kind = "response" if low is None or page == low else "revisit"
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page, url, kind, low, payload, base64.b32encode(sha).decode())) + packer.flush()
                    lines.append((reversed_host(url) + SEPARATOR + ("" if page is None else str(page)), name, at, len(member)))
                    at += len(member)
                    yield member

        stream = members()
        head = next(stream, None)
        if head is not None:
            _put(f"{folder}/archive/{name}", (x for part in ([head], stream) for x in part))
        yield pd.DataFrame(lines, columns=["key", "file", "start", "length"])

    return ready.select("page_id", "url", "payload", "sha", "first").mapInPandas(_whole(write, ("page_id", "first")), "key string, file string, start long, length long")


def _whole(f, names):
    def g(batches):
        return f(d.astype({n: "Int64" for n in names}) for d in batches)

    return g


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """Sorted, compressed blocks below ``folder``. Each index file ends with its sparse
    directory: first key, start and length of every block. Gives (first key, file, start
    and length of the directory) of each file in key order: a row per partition."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"part-{TaskContext.get().partitionId():05d}.idx"
        blocks: list[tuple] = []
        found: list[tuple] = []

        def packed():
            at, rows = 0, []

            def block():
                data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode())
                blocks.append((rows[0][0], at, len(data)))
                return data

            for d in batches:
                for r in zip(d["key"], d["file"], d["start"].tolist(), d["length"].tolist()):
                    rows.append(r)
                    if len(rows) == BLOCK_LINES:
                        yield (x := block())
                        at += len(x)
                        rows = []
            if rows:
                yield (x := block())
                at += len(x)
            if blocks:
                yield (x := zlib.compress(json.dumps(blocks).encode()))
                found.append((blocks[0][0], name, at, len(x)))

        stream = packed()
        head = next(stream, None)
        if head is not None:
            _put(f"{folder}/index/{name}", (x for part in ([head], stream) for x in part))
        yield pd.DataFrame(found, columns=["first", "file", "start", "length"])

    ordered = captures.repartitionByRange("key", "file", "start").sortWithinPartitions("key", "file", "start")
    parts = ordered.mapInPandas(write, "first string, file string, start long, length long")
    return sorted(map(tuple, parts.collect()))  # one row per partition


def lookup(keys: DataFrame, parts: list[tuple[str, str, int, int]], folder: str) -> DataFrame:
    """For each distinct ``key``: its captures (key, file, start, length)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = [p[0] for p in parts]
        opened = directory = firsts = block = at = None

        def inflate(file, start, length):
            store, path = _store(f"{folder}/index/{file}")
            with store.open_input_file(path) as f:
                f.seek(start)
                return zlib.decompress(f.read(length)).decode()

        for d in batches:
            out = []
            for key in d["key"]:
                # equal keys may straddle blocks and files: begin at the last that starts before
                for n in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
                    if opened != n:
                        opened, directory = n, json.loads(inflate(*parts[n][1:]))
                        firsts = [b[0] for b in directory]
                    for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                        if at != (n, k):
                            at, block = (n, k), [json.loads(x) for x in inflate(parts[n][1], *directory[k][1:]).split("\n")]
                        i = bisect.bisect_left(block, [key])
                        while i < len(block) and block[i][0] == key:
                            out.append(tuple(block[i]))
                            i += 1
            yield pd.DataFrame(out, columns=["key", "file", "start", "length"])

    dealt = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return dealt.mapInPandas(find, "key string, file string, start long, length long")


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Parse the records at (file, start, length) by range reads, in file order."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for d in batches:
            out = []
            for file, start, length in zip(d["file"], d["start"].tolist(), d["length"].tolist()):
                if file != name:
                    if f is not None:
                        f.close()
                    store, path = _store(f"{folder}/archive/{file}")
                    name, f = file, store.open_input_file(path)
                f.seek(start)
                x = parse_record(zlib.decompress(f.read(length), 31))
                out.append([x[k] for k in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")])
            yield pd.DataFrame(out, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]).astype({"page_id": "Int64", "refers_to": "Int64"})
        if f is not None:
            f.close()

    # neighbouring records of a file go to one task, but a large file is dealt to several
    dealt = places.repartitionByRange("file", "start").sortWithinPartitions("file", "start")
    return dealt.mapInPandas(read, RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    captures = cut(write_archives(pages, folder))
    parts = write_index(captures, folder)
    found = cut(lookup(captures.select("key"), parts, folder))  # range partitioning reads it twice
    return read_records(found, folder).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = "array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', substr(s, i, 1)) - 3, 4)), '')"
_FIVE = " + ".join(f"{16 >> k} * cast(substr(bits, 5 * j + {k + 1}, 1) as int)" for k in range(5))
OP2_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages),
q as (select page_id, url, strlen(h) as payload_bytes, s, {_BITS} as bits, min(page_id) over (partition by s) as low from p)
select page_id, url, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') as payload_digest,
       case when page_id = low then 'response' else 'revisit' end as record_type,
       case when page_id <> low then low end as refers_to
from q
"""
