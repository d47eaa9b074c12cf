"""Named progress of a long iteration, so that another session can take it up.

A run has a folder under its name. A step writes its tables into a folder of its own, and the
progress of the run is a table of small JSON files, one for each change of phase:

    expanding    the step is being written into ``step-n.tmp``; broken off here, what it wrote
                 is rolled back and the step is done again
    committing   everything is written and counted; broken off here, the step is finished:
                 its folder gets its name, if it has not got it yet
    ready        the step is done, and later steps may read it

A progress file appears by a rename, so a phase is there or not. Whoever starts a run under
the same name first recovers the step that was broken off, then goes on after the last one
that is ready. The arguments of a run must be the same again; only its progress is kept.

Tables that later steps join on a key are kept in buckets, sorted by it (``bucketed``): a join
reads them in place and moves only its other side.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plyframe.persist import TASK_ROWS, shared_dir, written

READY, EXPANDING, COMMITTING = "ready", "expanding", "committing"


class Folder:
    """The few operations on the shared folder that a journal needs, through Spark's own file
    systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def rename(self, path: str, to: str) -> None:
        at, fs = self._at(path)
        if not fs.rename(at, self.jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} could not be renamed to {to}")

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def put(self, path: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        at, fs = self._at(f"{path}.tmp")
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.rename(f"{path}.tmp", path)

    def get(self, path: str) -> str:
        at, fs = self._at(path)
        file = fs.open(at)
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()


@dataclass
class Table:
    """One table of a step: its rows, what was counted with them, its key where in buckets."""

    schema: str
    counts: dict[str, int]
    key: str | None = None
    buckets: int = 0
    folders: list[str] = field(default_factory=list)


@dataclass
class Step:
    number: int
    phase: str
    tables: dict[str, Table] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"step": self.number, "phase": self.phase, "notes": self.notes, "tables": {k: vars(t) for k, t in self.tables.items()}})

    @staticmethod
    def of(text: str) -> Step:
        d = json.loads(text)
        return Step(d["step"], d["phase"], {k: Table(**t) for k, t in d["tables"].items()}, d["notes"])


class Stopped(Exception):
    """A run was broken off."""


def stop_at(number: int, phase: str) -> Callable[[Step], None]:
    """A watch that breaks a run off."""

    def watch(step: Step) -> None:
        if (step.number, step.phase) == (number, phase):
            raise Stopped(f"step {number}, {phase}")

    return watch


class Journal:
    """The steps of one run. Without a name it is a run of this session only, which writes no
    progress and whose folder persist.clear deletes. watch is called at every phase; tests and
    queries break a run off with it."""

    def __init__(self, spark: SparkSession, name: str | None = None, watch: Callable[[Step], None] | None = None):
        self.spark, self.files, self.watch, self.named = spark, Folder(spark), watch, name is not None
        self.path = f"{shared_dir(spark)}/journal-{name or uuid.uuid4().hex}"
        self.known: dict[tuple[int, str], str] = {}  # tables in buckets that the session's catalog has
        self.frames: dict[tuple[int, str], DataFrame] = {}
        if not self.named:
            written(spark, self.path)
        names = self.files.names(f"{self.path}/progress") if self.named else []
        log = [Step.of(self.files.get(f"{self.path}/progress/{x}")) for x in names if x.endswith(".json")]
        self.entries = len(log)
        self.steps = [x for x in log if x.phase == READY]
        if log and log[-1].phase != READY:
            self._recover(log[-1])

    def _recover(self, last: Step) -> None:
        if last.phase == EXPANDING:  # another attempt may have written some of its tables
            self.files.delete(self._folder(last.number) + ".tmp")
            return
        self._finish(last)

    def _folder(self, number: int) -> str:
        return f"{self.path}/step-{number:06d}"

    def _writing(self, number: int) -> str:
        return self._folder(number) + (".tmp" if self.named else "")

    def _put(self, step: Step) -> None:
        if self.named:
            self.files.put(f"{self.path}/progress/{self.entries:08d}.json", step.text())
        self.entries += 1
        if self.watch:
            self.watch(step)

    def _finish(self, step: Step) -> None:
        at = self._folder(step.number)
        if self.named and self.files.exists(at + ".tmp"):
            self.files.rename(at + ".tmp", at)
        ready = Step(step.number, READY, step.tables, step.notes)
        self._put(ready)
        self.steps.append(ready)

    def commit(
        self, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, counts: dict[str, Column] | None = None, folders: dict[str, list[str]] | None = None, **notes
    ) -> Step:
        """One step: writes the tables, those in ``keys`` in buckets of that column, those in
        ``folders`` by these columns, and counts the rows of each in the same job, and ``counts``
        in the first one."""
        number = self.steps[-1].number + 1 if self.steps else 0
        self._put(Step(number, EXPANDING, notes=notes))
        at, out = self._writing(number), {}
        if self.named:
            self.files.delete(at)
        for name, df in tables.items():
            seen = Observation()
            wanted = {"rows": F.count(F.lit(1)), **(counts or {} if not out else {})}
            watched = df.observe(seen, *(c.alias(k) for k, c in wanted.items()))
            key, buckets, by = (keys or {}).get(name), 0, (folders or {}).get(name, [])
            if key is None:
                watched.write.partitionBy(*by).parquet(f"{at}/{name}")
            else:
                buckets = bucketed(watched, key, f"{at}/{name}", by)
            try:
                got = seen.get
            except Py4JJavaError:  # a plan that turned out to be empty has nothing left that counts
                got = self.spark.read.schema(df.schema).parquet(f"{at}/{name}").agg(*(c.alias(k) for k, c in wanted.items())).first().asDict()
            out[name] = Table(df.schema.json(), {k: int(got[k] or 0) for k in wanted}, key, buckets, by)
        step = Step(number, COMMITTING, out, notes)
        self._put(step)
        self._finish(step)
        return self.steps[-1]

    def read(self, step: Step, name: str) -> DataFrame:
        here = (step.number, name)
        if here not in self.frames:
            t, at = step.tables[name], f"{self._folder(step.number)}/{name}"
            schema = StructType.fromJson(json.loads(t.schema))
            if t.key is None:
                self.frames[here] = self.spark.read.schema(schema).parquet(at)
            else:
                self.known[here] = catalogued(self.spark, at, schema, t.key, t.buckets, t.folders)
                self.frames[here] = self.spark.table(self.known[here])
        return self.frames[here]

    def forget(self, before: int, keep: tuple[str, ...] = ()) -> None:
        """Deletes the tables of earlier steps that nothing reads any more: all but those named
        in ``keep``."""
        for s in self.steps:
            for name in s.tables:
                if s.number < before and name not in keep and self.files.exists(f"{self._folder(s.number)}/{name}"):
                    self.files.delete(f"{self._folder(s.number)}/{name}")
        for key in [k for k in self.frames if k[0] < before and k[1] not in keep]:
            del self.frames[key]
            if key in self.known:
                self.spark.sql(f"drop table {self.known.pop(key)}")

    def progress(self) -> DataFrame:
        """(entry, step, phase, notes) as a table."""
        rows = self.spark.read.schema("step int, phase string, notes string").json(f"{self.path}/progress/*.json")
        return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("int").alias("entry"), "step", "phase", "notes")

    def drop(self) -> None:
        for name in self.known.values():
            self.spark.sql(f"drop table if exists {name}")
        self.known, self.frames = {}, {}
        self.files.delete(self.path)


def bucketed(df: DataFrame, key: str, path: str, folders: list[str] | None = None, rows: int = 0) -> int:
    """Writes df to the folder in buckets of the key, one sorted file each, in a folder for each
    value of the columns ``folders``; gives how many buckets: those of a shuffle, or as many as
    so many rows need."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    name = f"ply_{uuid.uuid4().hex}"
    df.repartition(n, key).write.partitionBy(*folders or []).bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    spark.sql(f"drop table {name}")  # the files stay; who reads them names them anew
    return n


def catalogued(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int, folders: list[str] | None = None) -> str:
    """A name in the session's catalog for what ``bucketed`` wrote."""
    name = f"ply_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = f"partitioned by ({', '.join(f'`{c}`' for c in folders)})" if folders else ""
    spark.sql(f"create table {name} ({columns}) using parquet {by} clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    if folders:
        spark.catalog.recoverPartitions(name)
    return name


def in_buckets(df: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """df written to the shared folder in buckets of the key, and read from there: joins and
    aggregations by the key need no exchange of it. Where the number of rows is given, more
    rows are more buckets, so the memory of a task that joins one does not grow with the table;
    left to itself, Spark puts partitions together until they are tens of megabytes
    compressed. persist.clear deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}"
    n = bucketed(df, key, path, rows=rows)
    written(spark, path)
    return spark.table(catalogued(spark, path, df.schema, key, n))
