"""Registered queries that write tables in the stored layouts and read them back, and their
SQL twins over the tables that they came from."""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.operators import folds
from plyframe.persist import shared_dir
from plyframe.plans import fixpoint
from plyframe.queries import _EVENTS, _SWEEP, _swept, boards_of, order_boards, query
from plyframe.sources import blocks, files, sinks
from plyframe.sources.derived import event_edges, event_nodes, supply_leaves, table


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}"


@query("select code, count(*) as n, sum(rank)::bigint as ranks from (select r as rank, coalesce(c_nationkey % 4, 0) as code from range((select max(c_custkey) + 3 from customer)) t(r) left join customer on c_custkey = r) group by code")
def plane_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-bit values by rank behind a header; ranks without a value are 0."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rank"), F.pmod("c_nationkey", F.lit(4)).cast("short").alias("code"))
    n = c.agg(F.max("rank")).first()[0] + 3
    uri = f"{_folder(spark)}/plane"
    sinks.write_plane(c, uri, n, 2, b"HEADER")
    return files.read_plane(spark, uri, n, 2, 6).groupBy("code").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


_PROOFS = "select case when p_partkey % 2 = 0 then p_partkey * 7919 else -p_partkey end as key, p_size % 3 as res, p_size::bigint as best, p_partkey % 200 as depth from part"


def _proofs(spark: SparkSession, sf_dir: str) -> str:
    p = table(spark, sf_dir, "part")
    rows = p.select(
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") * 7919).otherwise(-F.col("p_partkey")).alias("key"),
        (F.col("p_size") % 3).alias("res"), F.col("p_size").alias("best"), (F.col("p_partkey") % 200).alias("depth"),
    )
    uri = f"{_folder(spark)}/proofs"
    sinks.write_proof_records(rows, uri, 5, 5, 1)
    return uri


@query(_PROOFS)
def proof_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_proof_records(spark, _proofs(spark, sf_dir)).select("key", "res", "best", "depth")


@query(f"with p as ({_PROOFS}) select * from p where key in (select l_partkey * 7919 from lineitem union all select -l_partkey from lineitem)")
def proof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every ordered part, asked for by both keys that a part may have."""
    asked = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.col("l_partkey") * 7919, -F.col("l_partkey"))).alias("key"))
    return files.lookup_records(asked, _proofs(spark, sf_dir), files.PROOF, ["key"]).select("key", "res", "best", "depth")


@query("select (o_orderkey % 4)::int as ply, o_orderkey as w0, o_custkey as w1, o_custkey % 3 - 1 as value from orders")
def layer_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.pmod("o_orderkey", F.lit(4)).cast("int").alias("ply"), F.col("o_orderkey").alias("w0"), F.col("o_custkey").alias("w1"), (F.pmod("o_custkey", F.lit(3)) - 1).alias("value"))
    uri = f"{_folder(spark)}/database"
    sinks.write_layer_database(rows, uri, 3, 3, [0, 0])
    return files.read_layer_database(spark, uri).select("ply", "w0", "w1", "value")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(16)).alias("section"), F.floor(F.col("event_id") / 256).alias("block"), "event_id", "event_type")
    parts = e.groupBy("section", "block").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))  # 256 ids a block
    return parts.select("section", "block", F.array_join("x.event_type", "").cast("binary").alias("data"))


@query("select user_id % 16 as section, event_id // 256 as block, sum(length(event_type))::bigint as n_bytes, md5(string_agg(event_type, '' order by event_id)) as digest, true as again from events group by 1, 2")
def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed sections, some of them written by a second run that goes on with those that
    are missing."""
    rows = _blocks(spark, sf_dir)
    path = _folder(spark)
    first = {r.section for r in sinks.write_sections(rows.where("section < 5"), path).collect()}
    later = {r.section for r in sinks.write_sections(rows, path).collect()}
    read = files.read_sections(spark, path)
    return read.select("section", "block", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"), F.lit(not first & later).alias("again"))


_BLOCKS = "select user_id % 16 as section, event_id // 256 as block, sum(length(event_type))::bigint as n_bytes, md5(string_agg(event_type, '' order by event_id)) as digest from events"


@query(_BLOCKS + " where user_id % 16 in (3, 7, 8) and event_id // 256 >= 5 group by 1, 2")
def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some blocks of some sections, chosen by a condition that the source evaluates."""
    path = _folder(spark)
    sinks.write_sections(_blocks(spark, sf_dir), path).collect()  # a row a section
    read = blocks.read_blocks_where(spark, path, "section in (3, 7, 8) and block >= 5", 16)
    return read.select("section", "block", F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))


@query("select row_number() over (order by o_orderkey) - 1 as rank, o_orderkey as c0, o_custkey as c1 from orders")
def npy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    def header(n: int) -> bytes:
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": "<u8", "fortran_order": False, "shape": (n, 2)})
        return out.getvalue()

    uri = f"{_folder(spark)}/table.npy"
    sinks.write_in_order(_pairs(spark, sf_dir), uri, ["a"], lambda d: (d[["a", "b"]].to_numpy(dtype="<u8").tobytes(), None), header)
    return files.read_npy(spark, uri)


@query("select o_orderkey as lo, o_custkey as hi, (o_orderkey % 3)::int as status from orders")
def dump_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a 128-bit position and a status."""

    def pack(d: pd.DataFrame) -> tuple[bytes, None]:
        out = np.zeros(len(d), dtype=[("lo", "<u8"), ("hi", "<u8"), ("status", "u1")])
        out["lo"], out["hi"], out["status"] = d["a"], d["b"], d["a"] % 3
        return out.tobytes(), None

    uri = f"{_folder(spark)}/dump"
    sinks.write_in_order(_pairs(spark, sf_dir), uri, ["a"], pack)
    return files.read_position_dump(spark, uri).select("lo", "hi", F.col("status").cast("int").alias("status"))


@query("select (o_custkey % 3)::int as code, count(*) as n, sum(rank)::bigint as ranks from (select *, row_number() over (order by o_orderkey) - 1 as rank from orders) group by 1")
def value_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte a state behind four header words."""
    uri = f"{_folder(spark)}/values"
    sinks.write_in_order(_pairs(spark, sf_dir), uri, ["a"], lambda d: ((d["b"] % 3).to_numpy(dtype=np.uint8).tobytes(), None), lambda n: struct.pack("<4Q", 0xCCB0F0CE, 7, 1, n))
    return files.read_value_dump(spark, uri, 7, 1).groupBy(F.col("code").cast("int").alias("code")).agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


@query(f"with {boards_of(36)}, n as (select l_orderkey as id, count(*) as n from lineitem group by 1) select row_number() over (order by id) - 1 as rank, a as mover, b as other, (id % 3)::int as kind, -n as lower, n + id % 20 as upper from boards join n using (id)")
def bounds_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the orders' boards with 36 cells, as text records of thirteen bytes."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    rows = order_boards(spark, sf_dir, 36).join(n, "id").select("id", F.col("a").alias("mover"), F.col("b").alias("other"), F.pmod("id", F.lit(3)).alias("kind"), (-F.col("n")).alias("lower"), (F.col("n") + F.pmod("id", F.lit(20))).alias("upper"))
    uri = f"{_folder(spark)}/bounds"
    sinks.write_bounds(rows, uri, "id")
    return files.read_bounds(spark, uri)


@query("select s_nationkey as empties, s_name as board, round(s_acctbal, 2) as book_wl, s_suppkey as nodes from supplier")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated results with a header; a row without a result is dropped."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(
        F.col("s_nationkey").alias("empties"), F.lit("b").alias("side"), F.round("s_acctbal", 2).alias("book_wl"), F.lit(0.5).alias("book_ssM"),
        F.lit("WIN").alias("result"), F.col("s_suppkey").alias("nodes"), F.lit(0.1).alias("seconds"), F.col("s_name").alias("board"),
    )
    path = _folder(spark)
    rows.unionByName(rows.limit(1).withColumn("result", F.lit(None).cast("string"))).write.csv(path, sep="\t", header=True)
    return files.read_calibration(spark, path).select("empties", "board", "book_wl", "nodes")


@query("select n, count(*) as turns, count(*) filter (role = 'assistant') as replies, sum(length(coalesce(text, '')))::bigint as chars from (select *, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as n from conversations) group by n")
def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON logs, a game a line."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    square = F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"))
    step = F.struct(square.alias("origin"), square.alias("heading"))
    game = F.struct(
        F.transform("t", lambda t: F.struct(F.coalesce(t["text"], F.lit("")).alias("board"), t["role"].alias("turn"))).alias("game_states"),
        F.transform("t", lambda t: F.struct(step.alias("passive"), step.alias("aggressive"))).alias("turns"),
        F.lit("BLACK").alias("winner"),
    )
    path = _folder(spark)
    c.select(F.to_json(game).alias("value")).write.text(path)
    log = files.read_game_logs(spark, path, lines=True)
    return log.groupBy("n").agg(F.count("*").alias("turns"), F.count_if(F.col("turn") == "assistant").alias("replies"), F.sum(F.char_length("board")).alias("chars"))


@query("select p_partkey as a, p_size::bigint as b, case p_partkey % 3 when 1 then 'W' when 2 then 'L' else 'D' end as verdict from part")
def verdict_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("a"), F.col("p_size").cast("long").alias("b"), F.lit(0).cast("long").alias("x"), F.when(F.col("p_partkey") % 3 == 1, 1).when(F.col("p_partkey") % 3 == 2, -1).otherwise(0).alias("value"))
    path = _folder(spark)
    sinks.write_verdict_text(rows, path)
    w = spark.read.text(path).select(F.split("value", " ").alias("w"))
    number = lambda i: F.conv(F.get("w", F.lit(i)), 16, 10).cast("long")
    return w.select(number(0).alias("a"), number(1).alias("b"), F.get("w", F.lit(3)).alias("verdict"))


@query(_SWEEP + "select layer, count(*) as states, sum(case when layer = 1 then -value else value end)::bigint as total, sum(id)::bigint as ids from v where layer in (1, 2) group by layer")
def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by layer, one layer of it written again; two layers are read."""
    path = _folder(spark)
    swept = _swept(spark, sf_dir)
    sinks.write_layers(swept, path)
    sinks.write_layers(swept.where("layer = 1").withColumn("value", -F.col("value")), path)
    return files.read_layers(spark, path, [1, 2]).groupBy("layer").agg(F.count("*").alias("states"), F.sum("value").alias("total"), F.sum("id").alias("ids"))


@query(_SWEEP + "select layer, count(*) filter (value = 1) as wins, count(*) filter (value = 0) as draws, count(*) filter (value = -1) as losses from v group by rollup (layer)")
def summary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{_folder(spark)}/summary.json"
    sinks.write_summary(folds.tally(_swept(spark, sf_dir)), uri)
    return spark.read.json(uri, schema="layer int, wins long, draws long, losses long", multiLine=True)


@query(f"with recursive {_EVENTS}, r as (select 1 as id union select dst from r join g on r.id = g.src) select case when id in (select id from r) and event_type = 'purchase' then -1 end as value, count(*) as states, count(*) filter (id in (select id from r)) as reached from n group by 1")
def reach_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with those of unreached events taken out, and how many are reached."""
    nodes = event_nodes(spark, sf_dir)
    reached = fixpoint.reach(event_edges(spark, sf_dir), spark.range(1, 2))
    both = sinks.add_reach(sinks.mask_unreached(nodes, reached), reached)
    return both.groupBy("value").agg(F.count("*").alias("states"), F.count_if("reachable").alias("reached"))


@query(
    _SWEEP.rsplit("v as (", 1)[0].rstrip().rstrip(",")
    + ", s2 as (select s_suppkey as id, coalesce(value, -1) as value from supplier left join v2 on id = s_suppkey), "
    "p1 as (select p_partkey as id, coalesce(max(-s2.value), -1) as value from part left join e on layer = 1 and src = p_partkey left join s2 on s2.id = dst group by p_partkey), "
    "below as (select l_orderkey as src, -p1.value as v from lineitem join p1 on p1.id = l_partkey union all select l_orderkey, -s2.value from lineitem join s2 on s2.id = l_suppkey), "
    "o0 as (select o_orderkey as id, coalesce(max(v), -1) as value from orders left join below on src = o_orderkey group by o_orderkey) "
    "select 0 as band, id, value from o0 union all select 1, id, value from p1 union all select 2, id, value from s2 union all select 3, id, value from leaf"
)
def banded_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, parts, suppliers and nations as bands; an order leads to its parts, and past
    them to its suppliers. Moves that are there twice change no maximum."""
    far = 1 << 40
    code = lambda band, c: F.col(c).cast("long") + band * far
    lines, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    none = F.lit(None).cast("int").alias("value")
    own = lambda t, c, band: table(spark, sf_dir, t).select(F.lit(band).alias("band"), code(band, c).alias("id"), none)
    leaves = supply_leaves(spark, sf_dir).select(F.lit(3).alias("band"), code(3, "id").alias("id"), "value")
    states = own("orders", "o_orderkey", 0).unionByName(own("part", "p_partkey", 1)).unionByName(own("supplier", "s_suppkey", 2)).unionByName(leaves)
    step = lambda df, a, i, b, k: df.select(code(i, a).alias("src"), code(k, b).alias("dst"))
    moves = step(lines, "l_orderkey", 0, "l_partkey", 1).unionByName(step(lines, "l_orderkey", 0, "l_suppkey", 2)).unionByName(step(lines, "l_partkey", 1, "l_suppkey", 2)).unionByName(step(supplier, "s_suppkey", 2, "s_nationkey", 3))
    swept = fixpoint.banded_sweep(states, moves, folds.negamax(), -1)
    return swept.select("band", F.pmod("id", F.lit(far)).alias("id"), "value")
