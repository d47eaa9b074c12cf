"""Block-compressed sections as a Spark data source:

    register(spark)
    spark.read.format("sections").load(folder).where("section = 3 and block >= 10")

A folder holds one file a section, as sinks.write_sections writes it: a table of blocks with
their keys, sizes and checksums, then the compressed blocks. Conditions on ``section`` leave
files out, conditions on ``block`` leave out blocks, which are then neither read nor
decompressed. Spark pushes both down; it asks for spark.sql.python.filterPushdown.enabled to
be on, which ``register`` sees to. A file of many blocks is several tasks' work.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from plyframe.sources.files import _read_plain, _store

#: bytes of a block's entry: key, packed size, size, checksum
ENTRY = struct.Struct("<QIII")
SCHEMA = "section long, block long, data binary"


@dataclass
class Blocks(InputPartition):
    """Entries first .. first + n of the table of one section's file."""

    section: int
    path: str
    first: int
    n: int
    total: int


def fits(value: int, conditions: list[tuple[str, object]]) -> bool:
    checks = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b}
    return all(checks[op](value, b) for op, b in conditions)


class SectionReader(DataSourceReader):
    OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, path: str, blocks_per_task: int):
        self.path, self.per_task = path, blocks_per_task
        self.conditions: dict[str, list[tuple[str, object]]] = {"section": [], "block": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what it can check itself and gives the rest back."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.conditions and type(f) in self.OPS and f.value is not None:
                self.conditions[name].append((self.OPS[type(f)], f.value))
            elif name in self.conditions and isinstance(f, In) and None not in f.value:
                self.conditions[name].append(("in", tuple(f.value)))
            elif name in self.conditions and isinstance(f, IsNotNull):
                continue  # they never are
            else:
                yield f

    def partitions(self) -> list[Blocks]:
        from pyarrow import fs

        store, at = _store(self.path)
        found = re.compile(r"section-(\d+)\.z$")
        out = []
        for x in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
            m = found.search(x.base_name)
            if m and fits(int(m[1]), self.conditions["section"]):
                uri = f"{self.path}/{x.base_name}"
                (total,) = struct.unpack("<Q", _read_plain(uri, 0, 8))
                out += [Blocks(int(m[1]), uri, k, min(self.per_task, total - k), total) for k in range(0, total, self.per_task)]
        return out

    def read(self, partition: Blocks | None) -> Iterator[tuple[int, int, bytes]]:
        if partition is None:  # no section fits
            return
        p = partition
        entries = list(ENTRY.iter_unpack(_read_plain(p.path, 8, ENTRY.size * (p.first + p.n))))
        at = 8 + ENTRY.size * p.total + sum(e[1] for e in entries[: p.first])
        for block, packed, size, crc in entries[p.first :]:
            if fits(block, self.conditions["block"]):
                try:
                    data = zlib.decompress(_read_plain(p.path, at, packed))
                except zlib.error as e:
                    raise ValueError(f"block {block} of section {p.section} is damaged") from e
                if len(data) != size or zlib.crc32(data) != crc:
                    raise ValueError(f"block {block} of section {p.section} is damaged")
                yield p.section, block, data
            at += packed


class SectionSource(DataSource):
    """Options: path, and blocks_per_task (1024)."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SectionReader:
        return SectionReader(self.options["path"], int(self.options.get("blocks_per_task", 1024)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push conditions down."""
    spark.dataSource.register(SectionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_blocks_where(spark: SparkSession, path: str, condition: str | None = None, blocks_per_task: int = 1024) -> DataFrame:
    """(section, block, data) of a folder of sections, under a condition on section and block."""
    register(spark)
    rows = spark.read.format("sections").option("blocks_per_task", blocks_per_task).load(path)
    return rows if condition is None else rows.where(condition)
