"""The registered queries of the engine's own operators, and their SQL twins."""

from __future__ import annotations

import uuid
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyframe.functions import bits, ranking, symmetry
from plyframe.operators import folds, stored, tables
from plyframe.persist import cut, written
from plyframe.plans import bitmaps, demand, fixpoint, journal, partwise, refinement
from plyframe.sources import boards
from plyframe.sources.derived import event_edges, event_nodes, supply_edges, supply_leaves, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- masks and numbers out of tables -----------------------------------------------------

def order_masks(spark: SparkSession, sf_dir: str, cells: int) -> DataFrame:
    """(id, mask): of every order the cells that its parts fall on."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr(f"shiftleft(1L, cast(pmod(l_partkey, {cells}) as int))").alias("bit"))
    return lines.groupBy("id").agg(F.bit_or("bit").alias("mask"))


def order_boards(spark: SparkSession, sf_dir: str, cells: int = 9) -> DataFrame:
    """(id, a, b): boards, 3 x 3 ones as they are, on which odd lines are of one side, even ones
    of the other where the cell is free."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.expr(f"shiftleft(1L, cast(pmod(l_partkey, {cells}) as int))").alias("bit"), (F.col("l_linenumber") % 2 == 1).alias("odd"))
    side = lambda c: F.coalesce(F.bit_or(F.when(c, F.col("bit"))), F.lit(0).cast("long"))
    both = lines.groupBy("id").agg(side(F.col("odd")).alias("a"), side(~F.col("odd")).alias("b"))
    return both.select("id", "a", F.col("b").bitwiseAND(F.bitwise_not("a")).alias("b"))


def _masks(cells: int) -> str:
    return f"masks as (select l_orderkey as id, bit_or(1::bigint << (l_partkey % {cells})::int) as mask from lineitem group by l_orderkey)"


def boards_of(cells: int) -> str:
    return (
        f"ab as (select l_orderkey as id, coalesce(bit_or(case when l_linenumber % 2 = 1 then 1::bigint << (l_partkey % {cells})::int end), 0) as a, "
        f"coalesce(bit_or(case when l_linenumber % 2 = 0 then 1::bigint << (l_partkey % {cells})::int end), 0) as b0 from lineitem group by l_orderkey), boards as (select id, a, b0 & ~a as b from ab)"
    )


_BOARDS9 = boards_of(9)


@query("""
with d as (select o_orderkey as id, unnest(range(18)) as c from orders),
v as (select id, c, (id // (3 ** c)::bigint) % 3 as x from d)
select id, cast(sum(case when x = 1 then 1 << c else 0 end) as bigint) as a, cast(sum(case when x = 2 then 1 << c else 0 end) as bigint) as b from v group by id
""")
def rank_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as ranks of boards with eighteen cells of three kinds."""
    return boards.decode_ternary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 18)


@query("select o_orderkey as id, (o_orderkey // 30) % 12 as i0, (o_orderkey // 2) % 15 as i1, o_orderkey % 2 as i2 from orders")
def product_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers as members of a product of ranges."""
    return boards.in_product(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), [12, 15, 2])


@query("with r as (select row_number() over (order by i) - 1 as rank, i as mask from generate_series(0, 4095) t(i) where bit_count(i) = 5) select p_partkey, mask from part join r on rank = p_partkey % 792")
def subset_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-subset of twelve cells that each part's number stands for."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(792)).alias("rank"))
    return p.select("p_partkey", ranking.colex_unrank("rank", 12, 5).alias("mask"))


def wall_slots(spark: SparkSession, n: int) -> DataFrame:
    """(id, x, y, o) of the wall slots of an n x n board, two cells long: o 0 horizontal, 1
    vertical."""
    return _slots(spark.range(2 * (n - 1) ** 2), n - 1)


def _slots(df: DataFrame, m: int) -> DataFrame:
    return df.select("*", F.pmod("id", F.lit(m)).alias("x"), F.pmod(F.floor(F.col("id") / m), F.lit(m)).alias("y"), F.floor(F.col("id") / (m * m)).alias("o"))


def order_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, id, x, y, o): the wall slots of a 6 x 6 board that the lines of every order fall
    on, each once."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.pmod("l_partkey", F.lit(50)).alias("id"))
    return _slots(journal.in_buckets(lines, "order", lines.count()).distinct(), 5)


def wall_conflict(a, b):
    """Same middle, or in line and overlapping by half."""
    cross = (a("x") == b("x")) & (a("y") == b("y"))
    across = (a("o") == 0) & (b("o") == 0) & (a("y") == b("y")) & (F.abs(a("x") - b("x")) == 1)
    along = (a("o") == 1) & (b("o") == 1) & (a("x") == b("x")) & (F.abs(a("y") - b("y")) == 1)
    return cross | across | along


_SLOTS = "slots as (select distinct l_orderkey as ord, l_partkey % 50 as id, l_partkey % 50 % 5 as x, (l_partkey % 50 // 5) % 5 as y, l_partkey % 50 // 25 as o from lineitem)"
_CONFLICT = "((a.x = b.x and a.y = b.y) or (a.o = 0 and b.o = 0 and a.y = b.y and abs(a.x - b.x) = 1) or (a.o = 1 and b.o = 1 and a.x = b.x and abs(a.y - b.y) = 1))"


@query(f'with {_SLOTS} select a.ord as "order", a.id as a, b.id as b from slots a join slots b on a.ord = b.ord and a.id < b.id and {_CONFLICT}')
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which walls of an order cross or overlap."""
    return tables.conflict_pairs(order_walls(spark, sf_dir), "id", wall_conflict, "order")


@query(
    f"with recursive {_SLOTS}, bad as (select a.ord, a.id as a, list(b.id) as no from slots a join slots b on a.ord = b.ord and a.id <> b.id and {_CONFLICT} group by 1, 2), "
    "f(ord, k, m, last) as (select distinct ord, 0, []::bigint[], -1::bigint from slots union all select f.ord, k + 1, list_append(m, s.id), s.id from f join slots s on s.ord = f.ord and s.id > last "
    "left join bad on bad.ord = s.ord and bad.a = s.id where k < 3 and not list_has_any(coalesce(no, []), m)) select k, count(*) as sets from f group by k"
)
def wall_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sets of up to three walls of an order do not cross or overlap."""
    walls = order_walls(spark, sf_dir)
    sets = tables.independent_sets_within(walls, tables.conflict_pairs(walls, "id", wall_conflict, "order"), "order", 3)
    return sets.groupBy("k").agg(F.count("*").alias("sets"))


@query(f"with {_BOARDS9} select id, a as x, b as o, cast(9 - bit_count(a) - bit_count(b) as int) as empty from boards")
def parse_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' boards written as text, and read back."""
    b = order_boards(spark, sf_dir)
    cell = lambda i: F.when(F.col("a").bitwiseAND(F.lit(1 << i)) != 0, "X").when(F.col("b").bitwiseAND(F.lit(1 << i)) != 0, "O").otherwise(".")
    text = F.concat_ws("/", *(F.concat(*(cell(3 * y + x) for x in range(3))) for y in range(3)))
    t = b.select("id", text.alias("board")).withColumn("board", boards.parse_rows("board"))
    return t.select("id", boards.mask_of("board", "X").alias("x"), boards.mask_of("board", "O").alias("o"), bits.count_char("board", ".").alias("empty"))


@query("""
select p_partkey, bit_count(p_partkey) as n, list_filter(range(20), lambda i: (p_partkey >> i) & 1 = 1) as cells, p_partkey as again,
       p_partkey & -p_partkey as low from part
""")
def bits_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set bits of every part's number; the cells shown are the first twenty, the number is
    put together from all of them."""
    p = table(spark, sf_dir, "part").select("p_partkey").withColumn("every", bits.cells("p_partkey", 63))
    cells = F.filter("every", lambda i: i < 20).cast("array<bigint>")
    return p.select("p_partkey", bits.popcount("p_partkey").cast("long").alias("n"), cells.alias("cells"), bits.from_cells("every").alias("again"), bits.lowest_bit("p_partkey").alias("low"))


@query("""
select o_orderkey, list_transform(range(12), lambda i: (o_orderkey // (4 ** i)::bigint) % 4) as digits, o_orderkey as packed,
       o_orderkey % 1048576 as low_cells from orders
""")
def pack_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey").withColumn("digits", bits.unpack("o_orderkey", 4, 12))
    mask = (1 << 20) - 1
    return o.select("o_orderkey", F.col("digits").cast("array<bigint>").alias("digits"), bits.pack("digits", 4).alias("packed"), bits.scatter(bits.gather("o_orderkey", mask), mask).alias("low_cells"))


@query("""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang,
       regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, cast(len(regexp_extract_all(html, '<p>')) as int) as paragraphs from pages
""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"),
        F.regexp_count("html", F.lit("<p>")).alias("paragraphs"),
    )


@query("select doc_id, sha256(text) || '  doc-' || doc_id as line from documents")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.sha2("text", 256), F.lit("  doc-"), F.col("doc_id").cast("string")).alias("line"))


# --- ranking and symmetry ----------------------------------------------------------------

@query("with n as (select o_orderkey, count(l_orderkey)::int as n from orders left join lineitem on l_orderkey = o_orderkey group by 1) select o_orderkey, n, (n * (n - 1) // 2)::bigint as pairs, (n * (n - 1) * (n - 2) // 6)::bigint as triples from n")
def binomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs and triples every order's lines make, from the table of coefficients."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    n = table(spark, sf_dir, "orders").select("o_orderkey").join(lines.withColumn("one", F.lit(1)), "o_orderkey", "left").groupBy("o_orderkey").agg(F.count("one").cast("int").alias("n"))
    c = ranking.binomials(spark, 20)
    of = lambda k, name: F.broadcast(c.where(F.col("k") == k).select("n", F.col("c").alias(name)))
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return n.join(of(2, "pairs"), "n", "left").join(of(3, "triples"), "n", "left").select("o_orderkey", "n", none("pairs"), none("triples"))


@query(f"""
with recursive {_masks(10)}, m as (select id, mask from masks where bit_count(mask) = 4),
c as (select id, mask, b, bit_count(mask & ((1 << b) - 1)) + 1 as j from m, generate_series(0, 9) u(b) where (mask >> b::int) & 1 = 1),
pascal(n, k, v) as (select 0, 0, 1 union all select n + 1, u, cast(round(exp(lgamma(n + 2) - lgamma(u + 1) - lgamma(n + 2 - u))) as int) from pascal, generate_series(0, 4) w(u) where n < 10 and k = 0 and u <= n + 1),
s as (select id, mask, sum(coalesce(v, 0)) as rank from c left join pascal on n = b and k = j group by id, mask)
select id, mask, cast(rank as bigint) as rank, mask as again from s
""")
def colex_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the orders' masks that have four of ten cells, and the masks again."""
    m = order_masks(spark, sf_dir, 10).where(F.bit_count("mask") == 4)
    m = m.withColumn("rank", ranking.colex_rank(bits.cells("mask", 10), 10, 4))
    return m.select("id", "mask", "rank", ranking.colex_unrank("rank", 10, 4).alias("again"))


@query("select c_custkey, row_number() over (order by c_mktsegment, c_custkey) - 1 as id from customer")
def dense_rank_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_ids(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment", "c_custkey"]).select("c_custkey", "id")


@query("""
with m as (select l_partkey, bit_or(1::bigint << (l_orderkey % 30)::int) as m from lineitem group by l_partkey)
select l_partkey, m, (m & (m >> 1) & (m >> 2) & (m >> 3)) <> 0 or (m & (m >> 5) & (m >> 10) & (m >> 15)) <> 0
       or (m & (m >> 6) & (m >> 12) & (m >> 18)) <> 0 or (m & (m >> 4) & (m >> 8) & (m >> 12)) <> 0 as four from m
""")
def four_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the orders of a part make a line of four on a board of thirty cells."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.expr("shiftleft(1L, cast(pmod(l_orderkey, 30) as int))").alias("bit"))
    m = lines.groupBy("l_partkey").agg(F.bit_or("bit").alias("m"))
    return m.select("l_partkey", "m", bits.lines_of_four("m", [1, 5, 6, 4]).alias("four"))


@query(f"""
with recursive {_masks(12)}, b as (select distinct mask as free from masks),
c as (select free, k as cell from b, generate_series(0, 11) u(k) where (free >> k::int) & 1 = 1),
r as (select free, min(cell) as cell from c group by free union
      select r.free, c.cell from r join c on r.free = c.free
      where (c.cell = r.cell + 4) or (c.cell = r.cell - 4) or (c.cell = r.cell + 1 and r.cell % 4 < 3) or (c.cell = r.cell - 1 and r.cell % 4 > 0)),
f as (select free, cast(sum(1 << cell::int) as bigint) as area from r group by free)
select id, free, area from masks join f on free = mask
""")
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs together with the first cell of every order's mask on a board of 4 x 3."""
    b = order_masks(spark, sf_dir, 12).withColumnRenamed("mask", "free")
    return b.select("id", "free", bits.flood(bits.lowest_bit("free"), "free", 4, 3).alias("area"))


_PERMS9 = symmetry.grid_symmetries(3, 3)
_IMAGES = (
    f"with {_BOARDS9}, d as (select id, a, b, unnest(range(9)) as c from boards), p(s, c, t) as (values " + ", ".join(f"({s}, {c}, {u})" for s, q in enumerate(_PERMS9) for c, u in enumerate(q)) + "), "
    "img as (select id, s, sum(case when (a >> c::int) & 1 = 1 then 1 << t else 0 end) as a, sum(case when (b >> c::int) & 1 = 1 then 1 << t else 0 end) as b from d join p using (c) group by id, s) "
)


@query(_IMAGES + "select id, cast(min(a * 1000 + b) // 1000 as bigint) as a, cast(min(a * 1000 + b) % 1000 as bigint) as b from img group by id")
def canonical_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' boards, each as the least of its images."""
    return order_boards(spark, sf_dir).select("id", symmetry.canonical(["a", "b"], _PERMS9).alias("k")).select("id", F.col("k.m0").alias("a"), F.col("k.m1").alias("b"))


@query(_IMAGES + ", o as (select id, min(a * 1000 + b) as k, count(distinct a * 1000 + b) as weight, min(case when s = 0 then a * 1000 + b end) as own from img group by id) select id, weight from o where k = own")
def orbit_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders whose boards stand for their images, and how many of these there are."""
    reps = order_boards(spark, sf_dir).where(symmetry.is_representative(["a", "b"], _PERMS9))
    return reps.select("id", symmetry.orbit_size(["a", "b"], _PERMS9).cast("long").alias("weight"))


@query(_IMAGES + ", every as (select distinct a * 1000 + b as own, cast(a as bigint) as a, cast(b as bigint) as b from img), e as (select own, s, sum(case when (a >> c::int) & 1 = 1 then 1 << t else 0 end) * 1000 + sum(case when (b >> c::int) & 1 = 1 then 1 << t else 0 end) as k from (select *, unnest(range(9)) as c from every) join p using (c) group by own, s) select (select count(distinct k) from (select min(k) as k from e group by own)) as orbits, count(*) filter (k = own) // 8 as burnside from e")
def burnside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits of all images of the orders' boards, by the least image and by fixed boards."""
    made = order_boards(spark, sf_dir).select(F.explode(F.array(*(F.struct(bits.permute("a", p).alias("a"), bits.permute("b", p).alias("b")) for p in _PERMS9))).alias("m")).select("m.*").distinct()
    fixed = sum((F.when(symmetry.fixed_by(["a", "b"], p), 1).otherwise(0) for p in _PERMS9), F.lit(0))
    return made.agg(F.count_distinct(symmetry.canonical(["a", "b"], _PERMS9)).alias("orbits"), F.call_function("div", F.sum(fixed), F.lit(8)).alias("burnside"))


# --- joins and folds over derived graphs -------------------------------------------------

_EDGES = "e as (select distinct 0 as layer, l_orderkey as src, l_partkey as dst from lineitem union all select distinct 1, l_partkey, l_suppkey from lineitem union all select 2, s_suppkey, s_nationkey from supplier), leaf as (select n_nationkey as id, n_regionkey % 3 - 1 as value from nation)"
_L2 = f"with {_EDGES}, v2 as (select src as id, max(-value) as value from e join leaf on dst = id where layer = 2 group by src)"


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges part to supplier, and the suppliers' values."""
    e = supply_edges(spark, sf_dir)
    v = folds.parents(e.where("layer = 2"), supply_leaves(spark, sf_dir))
    return e.where("layer = 1").select("src", "dst"), v


def _by_parent(found: DataFrame) -> DataFrame:
    """A row a parent: how many children were found, and sums that tell their values apart."""
    return found.groupBy("src").agg(F.count("*").alias("children"), F.sum("value").alias("total"), F.sum(F.col("dst") * (F.col("value") + 2)).alias("mixed"))


_BY_PARENT = " select src, count(*) as children, sum(value)::bigint as total, sum(dst * (value + 2))::bigint as mixed from ({}) group by src"


@query(_L2 + _BY_PARENT.format("select src, dst, value from e join v2 on dst = id where layer = 1"))
def child_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_parent(folds.child_lookup(*_suppliers(spark, sf_dir)))


@query(_L2 + _BY_PARENT.format("select src, dst, value from e join v2 on dst = id where layer = 1"))
def hash_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_parent(folds.child_lookup(*_suppliers(spark, sf_dir), missing="fail"))


@query(_L2 + _BY_PARENT.format("select src, dst, value from e join v2 on dst = id where layer = 1"))
def bucketed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and values stored in buckets of the child."""
    e, v = _suppliers(spark, sf_dir)
    return _by_parent(stored.bucketed_lookup(journal.in_buckets(e, "dst"), journal.in_buckets(v, "id")))


@query(_L2 + ", few as (select * from v2 where id % 2 = 0), f as (select src, dst, coalesce(value, 0) as value, value is null as gone from e left join few on dst = id where layer = 1) select src, count(*) as children, sum(value)::bigint as total, sum(dst * (value + 2))::bigint as mixed, count(*) filter (gone) as defaults from f group by src")
def default_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other supplier has no value and counts as drawn; how many did is told."""
    e, v = _suppliers(spark, sf_dir)
    found = folds.child_lookup(e, v.where("id % 2 = 0"), missing="draw")
    return _by_parent(found).join(found.groupBy("src").agg(F.count_if("defaulted").alias("defaults")), "src")


@query(_L2 + " select distinct src as id from e where layer = 1 and exists (select 1 from v2 where id = dst and value = -1)")
def semi_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.winners_by_semi_join(*_suppliers(spark, sf_dir))


@query("select o_orderkey as id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return folds.stuck(orders, supply_edges(spark, sf_dir).where("layer = 0"))


@query("select l_orderkey as id, count(*) as outdeg, count(distinct l_partkey) as n_children from lineitem group by 1")
def outdeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.out_degrees(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query(_L2 + " select src as id, case when bool_or(value = -1) then 1 when bool_and(value = 1) then -1 else 0 end as value from e join v2 on dst = id where layer = 1 group by src")
def negamax_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.parents(*_suppliers(spark, sf_dir))


@query("""
with e as (select distinct l_orderkey as src, l_partkey as dst from lineitem), n as (select p_partkey as id, p_size as pn, p_partkey % 7 + 1 as dn from part)
select src as id, least(min(dn), 1000000000) as pn, least(sum(pn), 1000000000)::bigint as dn from e join n on dst = id group by src
""")
def pn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("pn"), (F.pmod("p_partkey", F.lit(7)) + 1).alias("dn"))
    return folds.proof_numbers(supply_edges(spark, sf_dir).where("layer = 0").select("src", "dst"), n)


@query("select l_suppkey, l_partkey as part, l_quantity as score from (select *, row_number() over (partition by l_suppkey order by l_quantity desc, l_partkey) as k from lineitem) where k = 1")
def argmax_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_partkey")
    return folds.best_move(m, "l_suppkey", "l_quantity", "l_partkey").select("l_suppkey", F.col("move").alias("part"), "score")


# --- sweeps, reachability, counting ------------------------------------------------------

_SWEEP = (
    f"with {_EDGES}, v2 as (select src as id, max(-value) as value from e join leaf on dst = id where layer = 2 group by src), "
    "v1 as (select src as id, max(-value) as value from e join v2 on dst = id where layer = 1 group by src), "
    "v0 as (select src as id, max(-value) as value from e join v1 on dst = id where layer = 0 group by src), "
    "v as (select 3 as layer, id, value from leaf union all select 2, id, value from v2 union all select 1, id, value from v1 union all select 0, id, value from v0) "
)


def _swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.sweep(supply_edges(spark, sf_dir), supply_leaves(spark, sf_dir), folds.negamax(), 3)


@query(_SWEEP + "select layer, id, value from v")
def backward_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swept(spark, sf_dir)


@query(
    _SWEEP + ", top as (select layer from e group by layer order by count(*) desc, layer limit 1)"
    + _BY_PARENT.format("select src, dst, v.value from e join top using (layer) join v on v.layer = e.layer + 1 and v.id = e.dst")
)
def layer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of the layer that has the most edges; the values of other layers are not read."""
    e = cut(supply_edges(spark, sf_dir))
    top = e.groupBy("layer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "layer").limit(1).select("layer")
    return _by_parent(stored.layer_lookup(cut(e.join(F.broadcast(top), "layer")), stored.in_layers(_swept(spark, sf_dir))))


@query(_SWEEP + "select layer, count(*) filter (value = 1) as wins, count(*) filter (value = 0) as draws, count(*) filter (value = -1) as losses, count(*) filter (value is null) as open from v group by rollup (layer)")
def wdl_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.tally(_swept(spark, sf_dir))


@query(_SWEEP + "select value, count(*) as states, cast(sum(id % 2 + 1) as bigint) as weighted from v group by value")
def weighted_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.weighted_tally(_swept(spark, sf_dir).withColumn("weight", F.pmod("id", F.lit(2)) + 1))


@query(f"with recursive {_EDGES}, r(layer, id) as (select 0, o_orderkey from orders union select r.layer + 1, dst from r join e on r.layer = e.layer and r.id = e.src) select layer, count(*) as states from r group by layer")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply_edges(spark, sf_dir)
    roots = table(spark, sf_dir, "orders").select(F.lit(0).alias("layer"), F.col("o_orderkey").alias("id"))

    def expand(now: DataFrame) -> DataFrame:
        return now.join(e.select("layer", F.col("src").alias("id"), "dst"), ["layer", "id"]).select((F.col("layer") + 1).alias("layer"), F.col("dst").alias("id"))

    found = fixpoint.layers(roots, expand, ["layer", "id"])
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("layer").agg(F.count("*").alias("states"))


_EVENTS = (
    "n as (select event_id as id, event_type from events), k(k) as (values (1), (2)), size as (select count(*) as n from events), "
    "g as (select distinct id as src, (7 * id + k * (id % 11) + k) % size.n as dst from n, k, size where event_type <> 'purchase')"
)


_REACH = f"with recursive {_EVENTS}, r as (select 1 as id union select dst from r join g on r.id = g.src), d(id, depth) as (select 1, 0 union select dst, depth + 1 from d join g on d.id = g.src where depth < 40) select id, min(depth) as depth from d group by id"


@query(_REACH)
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.reach(event_edges(spark, sf_dir), spark.range(1, 2))


@query(_REACH)
def reach_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named run that is broken off after a pass, inside a commit and inside a pass, and goes
    on each time from its journal."""
    name = f"reach-{uuid.uuid4().hex}"
    edges, root = event_edges(spark, sf_dir), spark.range(1, 2)
    for at in ((2, journal.READY), (4, journal.COMMITTING), (5, journal.EXPANDING)):
        with suppress(journal.Stopped):
            fixpoint.reach(edges, root, journal=journal.Journal(spark, name, journal.stop_at(*at)))
    last = journal.Journal(spark, name)
    written(spark, last.path)
    return fixpoint.reach(edges, root, journal=last)


_MAPPED = (
    f"with recursive {_EDGES}, both_ways as (select layer, src, layer + 1 as far, dst from e union all select layer + 1, dst, layer, src from e), "
    "r(depth, layer, id) as (select 0, 3, n_nationkey from nation union select depth + 1, far, dst from r join both_ways b on r.layer = b.layer and r.id = b.src where depth < 8), "
    "d as (select layer, id, min(depth) as depth from r group by layer, id) "
)
#: number of a state in two parts
LAYER_BITS = 40


@query(_MAPPED + "select depth, layer, count(*) as states, sum(id)::bigint as total from d group by depth, layer")
def reach_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all nations at once along the supply edges in both directions, by bitmaps: how many
    states of which layer are how far away."""
    e = supply_edges(spark, sf_dir)
    code = lambda layer, x: F.shiftleft(layer.cast("long"), LAYER_BITS) + F.col(x)
    e = e.select(code(F.col("layer"), "src").alias("src"), code(F.col("layer") + 1, "dst").alias("dst"))
    roots = supply_leaves(spark, sf_dir).select(code(F.lit(3), "id").alias("id"))
    found = bitmaps.reach_maps(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), roots)
    states = bitmaps.ids_of(found).select("depth", F.shiftright("id", LAYER_BITS).cast("int").alias("layer"), F.expr(f"id & {(1 << LAYER_BITS) - 1}L").alias("id"))
    return states.groupBy("depth", "layer").agg(F.count("*").alias("states"), F.sum("id").alias("total"))


def _refined(rounds: int) -> str:
    """SQL of so many rounds, on numbers of layer and id together."""
    code = f"a as (select (layer::bigint << {LAYER_BITS}) + src as src, ((layer + 1)::bigint << {LAYER_BITS}) + dst as dst from e), ends as (select src as id, dst as other, 0 as way from a union all select dst, src, 1 from a), c0 as (select distinct id, 0::bigint as class from ends)"
    step = (
        "s{j} as (select e.id, list_sort(list(e.way::varchar || ':' || o.class)) as sign from ends e join c{i} o on o.id = e.other group by e.id), "
        "c{j} as (select c.id, min(c.id) over (partition by c.class, s.sign) as class from c{i} c join s{j} s using (id))"
    )
    return f"with {_EDGES}, {code}, " + ", ".join(step.format(i=i, j=i + 1) for i in range(rounds)) + f" select id, class from c{rounds}"


@query(_refined(3))
def refined_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the supply graph that three rounds of colours do not tell apart."""
    e = supply_edges(spark, sf_dir)
    code = lambda layer, x: F.shiftleft(layer.cast("long"), LAYER_BITS) + F.col(x)
    return refinement.refine(e.select(code(F.col("layer"), "src").alias("src"), code(F.col("layer") + 1, "dst").alias("dst")), 3)


@query(_SWEEP + "select layer, id, value from v")
def sweep_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep in parts, broken off between two parts and inside the commit of one."""
    name = f"parts-{uuid.uuid4().hex}"
    edges, leaves = supply_edges(spark, sf_dir), supply_leaves(spark, sf_dir)
    for at in ((4, journal.READY), (12, journal.COMMITTING)):
        with suppress(journal.Stopped):
            partwise.sweep_in_parts(edges, leaves, 3, journal=journal.Journal(spark, name, journal.stop_at(*at)))
    last = journal.Journal(spark, name)
    written(spark, last.path)
    return partwise.sweep_in_parts(edges, leaves, 3, journal=last)


@query("select l_returnflag as flag, count(*) as rows, count(distinct l_partkey) as distinct_keys, round(count(*) / count(distinct l_partkey), 6) as ratio from lineitem group by 1")
def multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.multiplicity(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag").withColumnRenamed("l_returnflag", "flag")


_WALK = "w{j} as (select dst as id, sum(paths) as paths from w{i} join g on id = src group by dst)"


@query(f"with {_EVENTS}, w0 as (select id, 1 as paths from n), " + ", ".join(_WALK.format(i=i, j=i + 1) for i in range(5)) + " select ply, count(*) as states, cast(sum(paths) as decimal(38, 0)) as paths, cast(sum(paths * id) as decimal(38, 0)) as mixed from (" + " union all ".join(f"select {i} as ply, id, paths from w{i}" for i in range(6)) + ") group by ply")
def perft(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = folds.count_paths(event_edges(spark, sf_dir), event_nodes(spark, sf_dir).select("id"), 5)
    total = lambda c: F.sum(c).cast("decimal(38,0)")
    return walks.groupBy("ply").agg(F.count("*").alias("states"), total(F.col("paths")).alias("paths"), total(F.col("paths") * F.col("id")).alias("mixed"))


@query("""
with l as (select l_orderkey, cast(l_quantity as bigint) as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) - 1 as i from lineitem),
o as (select l_orderkey, list(q order by i) as qs, count(*) as n from l group by 1),
s as (select l_orderkey, list_sum(list_transform(range(n), lambda i: case when (m >> i::int) & 1 = 1 then qs[i + 1] else 0 end)) % 7 as residue from (select *, unnest(range(1 << n::int)) as m from o))
select l_orderkey, coalesce(residue, 0)::int as residue, cast(count(*) as decimal(38, 0)) as ways from s group by 1, 2
""")
def count_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many ways some of an order's lines add up to each remainder of seven. Lines of
    the same remainder do the same to the counts, so an order is seven numbers of lines, made
    in one aggregation; its counts then take one line after the other, taken or left."""
    q = F.pmod(F.coalesce(F.col("l_quantity").cast("long"), F.lit(0)), F.lit(7))  # an unknown quantity adds nothing
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.count_if(q == r).alias(f"n{r}") for r in range(7)))
    whole = lambda x: F.lit(x).cast("decimal(38,0)")

    def with_line(r: int):
        return lambda w, _: F.array(*((w[k] + w[(k - r) % 7]).cast("decimal(38,0)") for k in range(7)))

    own = own.select("l_orderkey", *(f"n{r}" for r in range(7)), F.array(whole(1), *(whole(0) for _ in range(6))).alias("ways"))
    for r in range(7):
        own = own.withColumn("ways", F.aggregate(F.array_repeat(F.lit(0), F.col(f"n{r}").cast("int")), F.col("ways"), with_line(r)))
    return own.select("l_orderkey", F.posexplode("ways").alias("residue", "ways")).where("ways > 0")


# --- fixpoints on a cyclic graph ---------------------------------------------------------

_ATTRACT = (
    f"with recursive {_EVENTS}, a(pass, id, value, hit) as ("
    "select 0, id, case when event_type = 'purchase' then -1 end, case when event_type = 'purchase' then 0 end from n union all "
    "select pass + 1, id, new, case when value is null and new is not null then pass + 1 else hit end from ("
    "select p.pass, p.id, p.value, p.hit, coalesce(p.value, case when bool_or(c.value = -1) then 1 when count(g.dst) > 0 and bool_and(coalesce(c.value, 0) = 1) then -1 end) as new "
    "from a p left join g on g.src = p.id left join a c on c.id = g.dst group by p.pass, p.id, p.value, p.hit) where pass < {most}), "
    "s as (select id, value, hit as decided_at from a where pass = {most}) "
)


def _attracted(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    return fixpoint.attractor(event_nodes(spark, sf_dir), event_edges(spark, sf_dir), most)


@query(_ATTRACT.format(most=80) + "select id, value, decided_at from s")
def retro_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attracted(spark, sf_dir)


@query(_ATTRACT.format(most=80) + "select id, value, decided_at from s")
def retro_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on open events in sixteen ranges, of which a pass reads those with open ones."""
    nodes = event_nodes(spark, sf_dir)
    n = max(nodes.count(), 1)
    part = F.least(F.lit(15).cast("long"), F.call_function("div", F.col("id") * 16, F.lit(n)))
    return fixpoint.attractor(nodes, event_edges(spark, sf_dir), part=part)


@query(_ATTRACT.format(most=80) + "select value, max(decided_at) as max_depth, count(*) as states from s where value is not null group by value")
def attractor_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.depth_by_value(_attracted(spark, sf_dir))


@query(_ATTRACT.format(most=80) + "select decided_at, count(*) filter (value = 1) as new_wins, count(*) filter (value = -1) as new_losses from s where decided_at is not null group by decided_at")
def pass_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.pass_history(_attracted(spark, sf_dir))


@query(_ATTRACT.format(most=6) + "select id, value, decided_at from s")
def bounded_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attracted(spark, sf_dir, 6)


@query(_ATTRACT.format(most=80) + "select id, coalesce(value, 0) as value from s")
def unresolved_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attracted(spark, sf_dir).select("id", F.coalesce("value", F.lit(0)).alias("value"))


@query("select cast(null as bigint) as id, cast(null as int) as value, cast(null as int) as expected where false")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.audit(_attracted(spark, sf_dir), event_edges(spark, sf_dir))


@query("select cast(null as bigint) as id, cast(null as int) as decided_at, cast(null as int) as expected where false")
def depth_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.depth_audit(_attracted(spark, sf_dir), event_edges(spark, sf_dir))


@query(_ATTRACT.format(most=80) + "select g.src as id, g.dst as move, -coalesce(s.value, 0) as value, s.decided_at from g join s on g.dst = s.id")
def probe_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = event_nodes(spark, sf_dir).select("id")
    return fixpoint.probe_moves(asked, event_edges(spark, sf_dir), _attracted(spark, sf_dir))


_PLANTED = "v as (select id, case when id % 97 <> 0 then coalesce(value, 0) when coalesce(value, 0) = 0 then 1 else 0 end as value from s)"


@query(
    _ATTRACT.format(most=80)
    + f", {_PLANTED}, w as (select g.src as id, max(-v.value) as expected from g join v on g.dst = v.id group by g.src) select id, value, expected from v join w using (id) where value <> expected"
)
def audit_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit finds where every ninety-seventh value is wrong."""
    value = F.coalesce("value", F.lit(0))
    wrong = F.when(F.col("id") % 97 != 0, value).when(value == 0, 1).otherwise(0)
    return fixpoint.audit(cut(_attracted(spark, sf_dir).select("id", wrong.alias("value"))), event_edges(spark, sf_dir))


@query(
    _ATTRACT.format(most=80)
    + ", lost as (select distinct g.src as id from g join n on g.dst = n.id where n.event_type = 'purchase'), "
    "kept as (select g.src, g.dst from g left join lost on lost.id = g.src join n on n.id = g.dst where lost.id is null or n.event_type = 'purchase'), "
    "met as (select id from n where id % 20 = 0 union select kept.dst from met join kept on kept.src = met.id) "
    "select s.id, value, decided_at, (select count(*) from met) as states_met from s where s.id % 20 = 0"
)
def demanded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every twentieth event, and how many events were looked at for them."""
    nodes = event_nodes(spark, sf_dir)
    values, met = demand.evaluate(nodes.where("id % 20 = 0"), nodes, event_edges(spark, sf_dir))
    return values.withColumn("states_met", F.lit(met).cast("long"))


@query(
    _ATTRACT.format(most=80)
    + ", v as (select id, value, case when id % 89 = 0 then decided_at + 1 else decided_at end as decided_at from s), "
    "c as (select g.src as id, min(case when v.value = -1 then v.decided_at end) + 1 as quick, max(case when v.value = 1 then v.decided_at end) + 1 as slow from g join v on g.dst = v.id group by g.src) "
    "select id, decided_at, case value when 1 then quick else slow end as expected from v join c using (id) where value in (1, -1) and decided_at <> case value when 1 then quick else slow end"
)
def depth_audit_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit of distances finds where every eighty-ninth is one too long."""
    longer = F.col("decided_at") + F.when(F.col("id") % 89 == 0, 1).otherwise(0)
    return fixpoint.depth_audit(cut(_attracted(spark, sf_dir).withColumn("decided_at", longer)), event_edges(spark, sf_dir))


def _two_layers(nodes: DataFrame) -> DataFrame:
    n = F.col("id") < 300
    return nodes.select(F.when(n, 1).otherwise(0).alias("layer"), "id", "value")


_LAYERED_EDGES = "h as (select src, dst from g where not (src < 300 and dst >= 300 and src % 3 = 0) and not (src >= 300 and dst < 300))"


@query(
    f"with recursive {_EVENTS}, h as (select src, dst from g where src < 300 or dst >= 300), "
    "a(pass, id, value) as (select 0, id, case when event_type = 'purchase' then -1 end from n where id >= 300 union all "
    "select pass + 1, id, new from (select p.pass, p.id, coalesce(p.value, case when bool_or(c.value = -1) then 1 when count(h.dst) > 0 and bool_and(coalesce(c.value, 0) = 1) then -1 end) as new "
    "from a p left join h on h.src = p.id left join a c on c.id = h.dst group by p.pass, p.id, p.value) where pass < 80), "
    "low as (select id, coalesce(value, 0) as value from a where pass = 80), "
    "b(pass, id, value) as (select 0, id, case when event_type = 'purchase' then -1 end from n where id < 300 union all "
    "select pass + 1, id, new from (select p.pass, p.id, coalesce(p.value, case when bool_or(coalesce(c.value, low.value) = -1) then 1 when count(h.dst) > 0 and bool_and(coalesce(c.value, low.value, 0) = 1) then -1 end) as new "
    "from b p left join h on h.src = p.id left join b c on c.id = h.dst left join low on low.id = h.dst group by p.pass, p.id, p.value) where pass < 80) "
    "select 0 as layer, id, value from low union all select 1, id, coalesce(value, 0) from b where pass = 80"
)
def layered_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events below 300 lead into the rest, which is solved first."""
    e = event_edges(spark, sf_dir).where("src < 300 or dst >= 300")
    return fixpoint.layered_attractor(_two_layers(event_nodes(spark, sf_dir)), e, [0, 1]).select("layer", "id", "value")


@query(
    _ATTRACT.format(most=80)
    + ", root as (select id from s where value = 1 order by decided_at desc, id limit 1), line(n, id, value, hit) as (select 0, s.id, s.value, s.decided_at from s join root on s.id = root.id union all "
    "select n + 1, pick.id, pick.value, pick.hit from (select l.n, s.id, s.value, s.decided_at as hit, row_number() over (order by case when l.value = 1 then s.decided_at else -s.decided_at end, s.id) as k "
    "from line l join g on g.src = l.id join s on s.id = g.dst where s.value = -l.value) pick where k = 1) select n, id from line"
)
def pv(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _attracted(spark, sf_dir), event_edges(spark, sf_dir)
    v = cut(v)
    root = v.where("value = 1").orderBy(F.desc("decided_at"), "id").select("id").first()
    line = fixpoint.best_line(e, v, root.id) if root is not None else []
    return spark.createDataFrame(list(enumerate(line)), "n int, id bigint")


# --- comparisons, windows, sets ----------------------------------------------------------

@query("""
with a as (select c_custkey as id, c_nationkey % 3 as value from customer), b as (select o_custkey as id, count(*) % 3 as value from orders group by 1)
select count(*) filter (b.id is null) as only_a, count(*) filter (a.id is null) as only_b,
       count(*) filter (a.id is not null and b.id is not null and a.value is not distinct from b.value) as equal,
       count(*) filter (a.id is not null and b.id is not null and a.value is distinct from b.value) as different
from a full join b on a.id = b.id
""")
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against those that ordered, and values that are mostly different."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.pmod("c_nationkey", F.lit(3)).cast("long").alias("value"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.pmod(F.count("*"), F.lit(3)).alias("value"))
    return tables.table_diff(a, b, "id", "value")


@query("""
with c as (select 0 as layer, count(*) as n from orders union all select 1, count(distinct l_partkey) from lineitem union all select 2, count(distinct l_suppkey) from lineitem
union all select 3, count(distinct s_nationkey) from supplier where s_suppkey in (select l_suppkey from lineitem)) select layer, n as expected, n as actual, true as ok from c
""")
def golden_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States found layer by layer against the numbers of keys in the tables."""
    line = table(spark, sf_dir, "lineitem")
    known = [
        table(spark, sf_dir, "orders").select("o_orderkey"),
        line.select("l_partkey"),
        line.select("l_suppkey"),
        table(spark, sf_dir, "supplier").join(line, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_nationkey"),
    ]
    golden = reduce(DataFrame.unionByName, [x.distinct().agg(F.count("*").alias("expected")).select(F.lit(k).alias("layer"), "expected") for k, x in enumerate(known)])
    return tables.compare_golden(layer_counts(spark, sf_dir).withColumnRenamed("states", "actual"), golden, "layer")


@query("select r_regionkey, n, coalesce(sum(n) over (order by r_regionkey rows between unbounded preceding and 1 preceding), 0)::bigint as base from (select n_regionkey as r_regionkey, count(*) as n from nation group by 1)")
def prefix_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return folds.prefix_base(n, "r_regionkey", "n")


@query("select p_size, p_partkey, k as rank from (select p_size, p_partkey, cast(row_number() over (partition by p_size order by (p_partkey * 7919) % 104729, p_partkey) as int) as k from part) where k <= 8")
def bucket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return folds.bucket_sample(p, "p_size", F.pmod(F.col("p_partkey") * 7919, F.lit(104729)), 8).select("p_size", "p_partkey", "rank")


@query("select p_size // 10 as bucket, count(*) as n, count(*) filter (p_retailprice > 1400) as solved, round(avg(p_retailprice), 4) as mean, max(p_size) as most from part group by 1")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.call_function("div", F.col("p_size"), F.lit(10)).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.col("p_retailprice") > 1400).alias("solved"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.max("p_size").alias("most")
    )


@query("select l_partkey as id from lineitem where l_quantity > 45 union select p_partkey from part where p_size > 45")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return tables.union_sets(a, table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("id")))


@query("select l_suppkey as id from lineitem where l_quantity > 30 except all select l_suppkey from lineitem where l_discount > 0.05")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return tables.difference(x.where("l_quantity > 30").select(F.col("l_suppkey").alias("id")), x.where("l_discount > 0.05").select(F.col("l_suppkey").alias("id")))


@query("select p_partkey as id from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 40)")
def set_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return tables.new_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), seen, ["id"])


@query("select l_suppkey, bit_or(1::bigint << (l_partkey % 60)::int) as m from lineitem group by 1")
def bit_or_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_suppkey", bits.bit(F.pmod("l_partkey", F.lit(60))).alias("m"))
    return tables.merge_bits(x, "l_suppkey", "m")


@query("select count(distinct l_orderkey) as distinct_keys from lineitem")
def bitmap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bitmap_count(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("""
with a as (select p_partkey as id, p_size::bigint as lower, p_size::bigint + 10 as upper from part),
b as (select l_partkey as id, min(l_quantity)::bigint as lower, max(l_quantity)::bigint as upper from lineitem group by 1)
select id, greatest(a.lower, b.lower) as lower, least(a.upper, b.upper) as upper, greatest(a.lower, b.lower) <= least(a.upper, b.upper) as consistent from a full join b using (id)
""")
def bounds_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the parts' sizes and from the quantities that were ordered of them."""
    size = F.col("p_size").cast("long")
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), size.alias("lower"), (size + 10).alias("upper"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").cast("long").alias("lower"), F.max("l_quantity").cast("long").alias("upper"))
    return tables.merge_bounds(a, b, "id")


_ITEM = "cast('0x' || substr(md5(l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || {}), 1, 15) as bigint)"


@query(
    f"with l as (select l_orderkey, l_returnflag = 'R' as back, {_ITEM.format('cast(l_quantity as int)')} as h, {_ITEM.format('(cast(l_quantity as int) + 1)')} as h1 from lineitem) "
    "select l_orderkey, bit_xor(h) as before, bit_xor(case when back then h1 else h end) as after, true as same from l group by l_orderkey"
)
def hash_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every order's lines, before and after the returned ones changed: the new
    one from the old and from the lines that went and came, and whether it is that of all
    lines anew."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), (F.col("l_returnflag") == "R").alias("back"))
    item = lambda q: bits.item_hash("l_partkey", "l_suppkey", "l_linenumber", q)
    old = lines.groupBy("l_orderkey").agg(bits.set_hash(item("q")).alias("before"))
    delta = lines.where("back").groupBy("l_orderkey").agg(bits.set_hash(item("q")).alias("removed"), bits.set_hash(item(F.col("q") + 1)).alias("added"))
    anew = lines.withColumn("q", F.when(F.col("back"), F.col("q") + 1).otherwise(F.col("q"))).groupBy("l_orderkey").agg(bits.set_hash(item("q")).alias("anew"))
    after = old.join(delta, "l_orderkey", "left").withColumn("after", bits.updated_hash("before", "removed", "added"))
    return after.join(anew, "l_orderkey").select("l_orderkey", "before", "after", (F.col("after") == F.col("anew")).alias("same"))
