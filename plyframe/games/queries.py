"""Registered queries over small boards. Their SQL twins are independent formulations or
published counts, given as VALUES; none is this engine's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions import bits, ranking
from plyframe.functions.bits import shift
from plyframe.functions.predicates import board_columns, corner_state, mill_events
from plyframe.functions.symmetry import automorphisms, mirror_weight
from plyframe.functions.zdd import Zdd
from plyframe.games import native, scripted
from plyframe.games.core import Game, explore, replay, solve, summary
from plyframe.persist import cut
from plyframe.operators import folds, tables
from plyframe.plans import fixpoint, sampling
from plyframe.queries import _EDGES, _masks, boards_of, order_boards, order_masks, query, wall_conflict, wall_slots
from plyframe.sources.derived import event_edges, supply_edges, table


def _golden(game: Game, columns: str):
    return lambda spark: summary(spark, game).select(*columns.split())


@query("select 7 as states, 3 as wins, 4 as losses")
def game_amazons_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.one_queen(2, 2), "states wins losses")(spark)


@query("select 115 as states, 74 as wins, 41 as losses")
def game_amazons_2x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.one_queen(2, 3), "states wins losses")(spark)


@query("select 1148 as states, 832 as wins, 316 as losses")
def game_amazons_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.one_queen(3, 3), "states wins losses")(spark)


@query("select 0 as root_value")
def game_connect4_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.connect4(4, 4), "root_value")(spark)


@query("select 5934 as states, 1 as root_value")
def game_morris3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.morris3(colours=True), "states root_value")(spark)


@query("select 1 as root_value, 9 as root_plies")
def game_nocca_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(native.nocca(3, 3), "root_value root_plies")(spark)


@query("select 4704 as positions, 2304 as wins, 0 as draws, 96 as illegal")
def game_chinesecheckers_7x7_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides to move, wins of the first player; a state with the second player to move
    is the turned board, so its loss is a win of the first."""
    v = solve(spark, native.chinese_checkers(7))
    n = 49 * 48
    return v.agg(
        F.lit(2 * n).alias("positions"),
        (F.count_if(F.col("value") == 1) + F.count_if(F.col("value") == -1)).alias("wins"),
        (2 * F.count_if(F.col("value").isNull())).alias("draws"),
        (2 * (n - F.count("*"))).alias("illegal"),
    )


@query("select 1012 as states, 1 as root_value")
def game_fanorona_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(scripted.fanorona(3, 3), "states root_value")(spark)


@query("select * from (values ('2x3 w=0', 2), ('2x3 w=1', 1), ('3x3 w=0', 2)) t(board, winner)")
def game_quoridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for w, h, k in ((2, 3, 0), (2, 3, 1), (3, 3, 0)):
        v = F.col("root_value")
        one = summary(spark, scripted.quoridor(w, h, k)).select(F.lit(f"{w}x{h} w={k}").alias("board"), F.when(v == 1, 1).when(v == -1, 2).otherwise(0).alias("winner"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select 0 as root_value")
def game_twixt_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _golden(scripted.twixt(3, 3), "root_value")(spark)


@query("select * from (values (1, 26::bigint), (2, 500), (3, 5463)) t(depth, states)")
def game_shobu_4x3_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States within so many plies of the start, as published in sum over the depths."""
    nodes, _ = explore(spark, scripted.shobu(4, 3, 3), 3)
    nodes = cut(nodes)
    depth = spark.range(1, 4).select(F.col("id").cast("int").alias("upto"))
    within = nodes.join(F.broadcast(depth), F.col("depth") <= F.col("upto")).groupBy(F.col("upto").alias("depth")).agg(F.count("*").alias("states"))
    return within


_DROPS = "(((a | b) & (15::bigint << (5 * c)::int)) + (1::bigint << (5 * c)::int)) & (15::bigint << (5 * c)::int)"


@query(f"with recursive s(ply, a, b) as (select 0, 0::bigint, 0::bigint union select ply + 1, b, a | ({_DROPS}) from s, generate_series(0, 3) t(c) where ply < 4 and ({_DROPS}) <> 0) select ply, count(*) as states from s group by ply")
def expand_connect4(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = explore(spark, native.connect4(4, 4), 4)
    return nodes.groupBy(F.col("depth").alias("ply")).agg(F.count("*").alias("states"))


@query("""
with recursive c as (select x, y, (y * 3 + x) as i from generate_series(0, 2) a(x), generate_series(0, 4) b(y)),
m as (select s, 1::bigint << f.i as f, 1::bigint << t.i as t, f.x <> t.x as diagonal from c f join c t on abs(f.x - t.x) <= 1 join (values (0, 1), (1, -1)) d(s, step) on t.y = f.y + d.step),
p(ply, a, b, s) as (select 0, 63::bigint, 63::bigint << 9, 0 union
  select ply + 1, case when p.s = 0 then (a - m.f) | m.t else a & ~m.t end, case when p.s = 1 then (b - m.f) | m.t else b & ~m.t end, 1 - p.s
  from p join m on m.s = p.s and ((case when p.s = 0 then a else b end) & m.f) <> 0 and ((case when p.s = 0 then a else b end) & m.t) = 0
    and (diagonal or ((case when p.s = 0 then b else a end) & m.t) = 0) where ply < 4)
select ply, count(*) as states from p group by ply
""")
def expand_breakthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four plies on 3 x 5, where no pawn can yet be home."""
    nodes, _ = explore(spark, native.breakthrough(3, 5), 4)
    return nodes.groupBy(F.col("depth").alias("ply")).agg(F.count("*").alias("states"))


def zdd_levels(sets: DataFrame, variables: int) -> DataFrame:
    """(var, nodes) of the zero-suppressed diagram of a family of masks: a node of a level
    is a distinct set of what may follow a choice of smaller elements, if something of it
    holds the element. Families of a board's geometry, which are small."""
    out = None
    for v in range(variables):
        rest = sets.select(F.col("members").bitwiseAND(F.lit((1 << v) - 1).cast("long")).alias("before"), shift("members", -v).alias("after"))
        level = rest.groupBy("before").agg(F.sort_array(F.collect_set("after")).alias("follow"))
        level = level.where(F.exists("follow", lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1)).agg(F.count_distinct("follow").alias("nodes")).select(F.lit(v).alias("var"), "nodes")
        out = level if out is None else out.unionByName(level)
    return out


_Z = "with recursive slots as (select i as id, i % 3 as x, (i // 3) % 3 as y, i // 9 as o from generate_series(0, 17) t(i)), clash as (select a.id as a, b.id as b from slots a, slots b where a.id <> b.id and ((a.x = b.x and a.y = b.y) or (a.o = 0 and b.o = 0 and a.y = b.y and abs(a.x - b.x) = 1) or (a.o = 1 and b.o = 1 and a.x = b.x and abs(a.y - b.y) = 1))), shut as (select id, coalesce(bit_or(1 << b), 0) as no from slots left join clash on a = id group by id), f(k, m, last) as (select 0, 0, -1 union all select k + 1, m | (1 << id), id from f join shut on id > last and (m & no) = 0 where k < 3)"


@query(_Z + ", l as (select v, m & ((1 << v) - 1) as before, list_sort(list(distinct m >> v)) as follow, bool_or(((m >> v) & 1) = 1) as has from f, generate_series(0, 17) t(v) group by v, m & ((1 << v) - 1)) select cast(v as int) as var, count(distinct follow) as nodes from l where has group by v")
def zdd_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = wall_slots(spark, 4)
    sets = cut(tables.independent_sets(slots, tables.conflict_pairs(slots, "id", wall_conflict), 3))
    return zdd_levels(sets, 18)


@query(_Z + ", r as (select m, list_reduce(list_prepend(0::bigint, list_transform(range(18), lambda i: ((m >> i::int) & 1)::bigint)), lambda a, x: a * 2 + x) as k from f) select cast(m as bigint) as mask, row_number() over (order by k) - 1 as rank, cast(m as bigint) as again from r")
def zdd_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of wall sets by their diagram, and the sets again by their numbers."""
    slots = wall_slots(spark, 4)
    sets = cut(tables.independent_sets(slots, tables.conflict_pairs(slots, "id", wall_conflict), 3))
    z = Zdd.load(Zdd.of([r.members for r in sets.collect()], 18).table(spark))  # a board's geometry
    ranked = sets.select(F.col("members").alias("mask"), z.rank_column(spark, "members").alias("rank"))
    return ranked.join(z.scan(spark).select("rank", F.col("mask").alias("again")), "rank")


@query(f"""
with {_masks(9)}, m(i, k) as (values (0, 7), (1, 28), (2, 112), (3, 193), (4, 273), (5, 290), (6, 324), (7, 392)),
s as (select mask, list(k) as mm from (select distinct mask from masks), m where mask & k = k group by mask),
h as (select mask, min(bit_count(p)) as events from s, generate_series(0, 511) u(p) where len(list_filter(mm, lambda x: x & p = 0)) = 0 group by mask)
select id, mask, cast(coalesce(events, 0) as int) as events from masks left join h using (mask)
""")
def mill_closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many closings the mills of every order's mask need at least."""
    return mill_events(order_masks(spark, sf_dir, 9), "mask", [sum(1 << p for p in m) for m in native.MORRIS3_MILLS]).select("id", "mask", "events")


@query(f"""
with recursive {boards_of(9)}, d as (select distinct a, b from boards), c as (select i, i % 3 as x, i // 3 as y from generate_series(0, 8) t(i)),
adj as (select p.i as i, q.i as j from c p join c q on abs(p.x - q.x) + abs(p.y - q.y) = 1),
r(a, b, i, j) as (select a, b, i, i from d, c where ((a | b) >> i::int) & 1 = 0 union select r.a, r.b, r.i, adj.j from r join adj on adj.i = r.j where ((r.a | r.b) >> adj.j::int) & 1 = 0),
touch as (select r.a, r.b, r.i, bool_or((r.a >> adj.j::int) & 1 = 1) as black, bool_or((r.b >> adj.j::int) & 1 = 1) as white from r join adj on adj.i = r.j group by all),
area as (select a, b, sum(case when black and not white then 1 when white and not black then -1 else 0 end) as s from touch group by a, b)
select id, cast(bit_count(a) - bit_count(b) + coalesce(s, 0) as int) as score from boards left join area using (a, b)
""")
def go_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area scores of the orders' boards: stones and empty regions that touch one colour. Each
    different board is judged once."""
    b = cut(order_boards(spark, sf_dir))
    judged = b.select("a", "b").distinct().withColumn("score", board_columns("a", "b", 3, 3)["score"])
    return b.join(judged, ["a", "b"]).select("id", "score")


@query("""
with l as (select 1::bigint << (l_partkey % 16)::int as a, 1::bigint << (l_suppkey % 16)::int as b from lineitem),
c as (select l.*, spec, start, goal from l, (values (0, 1, 32768), (1, 8, 4096)) v(spec, start, goal) where a <> b)
select spec, case when (a | b) & goal = goal and a & goal <> 0 then 'illegal' when (a | b) & start = start and b & start <> 0 then 'lost' else 'open' end as state, count(*) as states from c group by 1, 2
""")
def rule_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as states of two pieces on 4 x 4, under two choices of home corners."""
    one = F.lit(1).cast("long")
    at = lambda c: F.call_function("shiftleft", one, F.pmod(c, F.lit(16)).cast("int"))
    s = table(spark, sf_dir, "lineitem").select(at("l_partkey").alias("a"), at("l_suppkey").alias("b")).where("a <> b")
    out = None
    for k, (start, goal) in enumerate(((1, 32768), (8, 4096))):
        part = s.select(F.lit(k).alias("spec"), corner_state("a", "b", start, goal).alias("state"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("spec", "state").agg(F.count("*").alias("states"))


@query("select o_orderkey as id from orders where ((o_orderkey * 48271 + 16807) % 2147483647) % 10 = 0")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_ids(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 10, 1)


@query(f"""
with {boards_of(9)}, n as (select id, bit_count(a) as n1, bit_count(b) as n2 from boards), f as (select i, round(exp(lgamma(i + 1)))::bigint as v from generate_series(0, 9) t(i))
select id, cast(x.v // (p.v * q.v * r.v) as decimal(38, 0)) as states from n join f x on x.i = 9 join f p on p.i = n1 join f q on q.i = n2 join f r on r.i = 9 - n1 - n2
""")
def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boards have as many pieces of each side as every order's."""
    n = order_boards(spark, sf_dir).select("id", F.bit_count("a").alias("n1"), F.bit_count("b").alias("n2"))
    return sampling.placement_counts(n, 9, ["n1", "n2"]).select("id", "states")


@query("select l_suppkey as id from lineitem where l_quantity > 30 intersect select l_suppkey from lineitem where l_discount > 0.05")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.where("l_quantity > 30").select(F.col("l_suppkey").alias("id")).intersect(x.where("l_discount > 0.05").select(F.col("l_suppkey").alias("id")))


@query("with e as (select distinct l_partkey as src, l_suppkey as dst from lineitem), d as (select s_nationkey as nation, count(*) as paths from e join supplier on dst = s_suppkey group by 1) select nation, cast(paths as decimal(38, 0)) as paths from d")
def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways down from parts to nations, counted layer by layer."""
    e = supply_edges(spark, sf_dir).where("layer > 0").select((F.col("layer").cast("long") * 1_000_000_000 + F.col("src")).alias("src"), ((F.col("layer").cast("long") + 1) * 1_000_000_000 + F.col("dst")).alias("dst"))
    parts = e.select(F.col("src").alias("id")).where("id < 2000000000").distinct()
    return folds.count_paths(e, parts, 2).where("ply = 2").select((F.col("id") - 3_000_000_000).alias("nation"), "paths")


@query("""
select conv_id, count(*) as turns, bool_and(ok) as valid from (
  select conv_id, turn, role, case when lag(turn) over w is null then turn = 0 and role in ('system', 'user')
    else turn = lag(turn) over w + 1 and ((role = 'assistant') = (lag(role) over w = 'user')) and role <> 'system' end as ok
  from conversations window w as (partition by conv_id order by turn)) group by conv_id
""")
def replay_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation played again: turns in sequence, sides in turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t, r = F.lag("turn").over(w), F.lag("role").over(w)
    ok = F.when(t.isNull(), (F.col("turn") == 0) & F.col("role").isin("system", "user")).otherwise(
        (F.col("turn") == t + 1) & ((F.col("role") == "assistant") == (r == "user")) & (F.col("role") != "system")
    )
    return table(spark, sf_dir, "conversations").withColumn("ok", ok).groupBy("conv_id").agg(F.count("*").alias("turns"), F.every("ok").alias("valid"))


_TREE = "t as (select o_orderkey as src, 1000000000 + o_custkey as dst from orders union select 1000000000 + c_custkey, 2000000000 + c_nationkey from customer union select 2000000000 + n_nationkey, 3000000000 + n_regionkey from nation)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): orders to customers to nations to regions."""
    far = 1_000_000_000
    step = lambda t, a, b, k: table(spark, sf_dir, t).select((F.col(a).cast("long") + k * far).alias("src"), (F.col(b).cast("long") + (k + 1) * far).alias("dst"))
    return step("orders", "o_orderkey", "o_custkey", 0).unionByName(step("customer", "c_custkey", "c_nationkey", 1)).unionByName(step("nation", "n_nationkey", "n_regionkey", 2))


@query(f"with recursive {_TREE}, r as (select src, dst from t union select r.src, t.dst from r join t on r.dst = t.src) select dst, count(*) as reached_by, sum(src)::bigint as of from r group by dst")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From how many nodes each node is reached, over all pairs of the closure."""
    return fixpoint.closure(_tree(spark, sf_dir)).groupBy("dst").agg(F.count("*").alias("reached_by"), F.sum("src").alias("of"))


@query("select cast(l_suppkey as bigint) as id, max(l_quantity) as best from lineitem group by 1")
def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_suppkey").alias("id")).agg(sampling.threshold(x, "l_quantity").alias("best"))


_BREAKTHROUGH = """
c as (select x, y, (y * 3 + x) as i from generate_series(0, 2) a(x), generate_series(0, 3) b(y)),
m as (select s, 1::bigint << f.i as f, 1::bigint << t.i as t, f.x <> t.x as diagonal from c f join c t on abs(f.x - t.x) <= 1 join (values (0, 1), (1, -1)) d(s, step) on t.y = f.y + d.step)"""


@query(f"""
with recursive {_BREAKTHROUGH},
r(game, ply, a, b, s) as (
  select g, 0, 63::bigint, 63::bigint << 6, 0 from generate_series(0, 49) t(g) union all
  select game, ply + 1, na, nb, 1 - s from (
    select *, row_number() over (partition by game order by ((((na | (nb << 12) | ((1 - s)::bigint << 24)) * 48271 + game * 69621 + ((ply + 1) * 16807 + 40014)) % 2147483647) * 48271) % 2147483647, na | (nb << 12) | ((1 - s)::bigint << 24)) as k
    from (select game, ply, r.s as s, case when r.s = 0 then (a - f) | t else a & ~t end as na, case when r.s = 1 then (b - f) | t else b & ~t end as nb
      from r join m on m.s = r.s and ((case when r.s = 0 then a else b end) & f) <> 0 and ((case when r.s = 0 then a else b end) & t) = 0 and (diagonal or ((case when r.s = 0 then b else a end) & t) = 0)
      where not (case when r.s = 0 then (b & 7) <> 0 or a = 0 else (a & (7 << 9)) <> 0 or b = 0 end))) where k = 1)
select game, ply, a | (b << 12) | (s::bigint << 24) as id from r
""")
def random_playouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty games of breakthrough on 3 x 4."""
    return sampling.playouts(spark, native.breakthrough(3, 4), 50, seed=1)


@query("select 50::bigint as games, 50::bigint as whole, 25::bigint as spoilt")
def replay_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty playouts played again under the rules: all are legal, and none of those of which
    every other one had a state changed."""
    game = native.breakthrough(3, 4)
    log = cut(sampling.playouts(spark, game, 50, seed=1))
    spoil = log.withColumn("id", F.when((F.col("ply") == 2) & (F.col("game") % 2 == 0), F.col("id").bitwiseXOR(F.lit(1).cast("long"))).otherwise(F.col("id")))
    whole = replay(game, log).groupBy("game").agg(F.every("legal").alias("ok"))
    bad = replay(game, spoil).groupBy("game").agg(F.every("legal").alias("still"))
    return whole.join(bad, "game").agg(F.count("*").alias("games"), F.count_if("ok").alias("whole"), F.count_if(~F.col("still")).alias("spoilt"))


_EVENT_GRAPH = "size as (select count(*) as n from events), g as (select distinct event_id as src, (7 * event_id + k * (event_id % 11) + k) % size.n as dst from events, (values (1), (2)) k(k), size where event_type <> 'purchase')"


@query(f"with {_EVENT_GRAPH}, a as (select distinct dst as id from g where src = 1 and dst <> 1), b as (select distinct dst as id from g where src in (select id from a) and dst <> 1 and dst not in (select id from a)) select 0 as depth, 1::bigint as states union all select 1, count(*) from a having count(*) > 0 union all select 2, count(*) from b having count(*) > 0")
def reach_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over the events stopped after two steps."""
    return fixpoint.reach(event_edges(spark, sf_dir), spark.range(1, 2), 2).groupBy("depth").agg(F.count("*").alias("states"))


@query("select 3267310::bigint as states, -1 as root_value")
def game_breakthrough_4x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published number of states of the full table, and that the second player wins."""
    states = native.breakthrough_positions(spark, 4, 4).agg((2 * F.count("*")).alias("states"))
    return states.join(summary(spark, native.breakthrough(4, 4)).select("root_value"))


@query(f"with recursive {_masks(9)}, s(k, m) as (select 0, 0 union all select k + 1, m | (1 << c) from s, generate_series(0, 8) t(c) where k < 4 and (m >> c) = 0), r as (select m::bigint as mask, row_number() over (order by list_transform(range(9), lambda i: 1 - ((m >> i::int) & 1))) - 1 as rank from s where k = 4) select id, mask, rank from masks join r using (mask)")
def subset_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicographic ranks of the orders' masks that have four of nine cells."""
    masks = order_masks(spark, sf_dir, 9).where("bit_count(mask) = 4")
    return masks.select("id", "mask", ranking.subset_rank_lex(bits.cells("mask", 9), 9, 4).alias("rank"))


@query(f"with {_masks(9)}, f as (select m as mask, b as block, row_number() over (partition by b order by m) - 1 as rank from generate_series(0, 511) t(m), generate_series(0, 511, 73) u(b) where bit_count(m) = 3 and m & b = 0) select id, mask, block, rank from masks join f using (mask) where block = 73 * (id % 8)")
def restricted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the orders' masks that have three cells, among those outside a block that the
    order's number chooses."""
    masks = order_masks(spark, sf_dir, 9).where("bit_count(mask) = 3").withColumn("block", 73 * F.pmod("id", F.lit(8)))
    rows = masks.where(F.col("mask").bitwiseAND(F.col("block")) == 0)
    return rows.select("id", "mask", "block", ranking.restricted_rank(bits.cells("mask", 9), "block", 9, 3).alias("rank"))


@query("select o_orderkey, case when o_totalprice > 100000 then row_number() over (partition by o_totalprice > 100000 order by o_orderkey) - 1 end as id from orders")
def selection_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the orders of a selection, null for those outside."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranking.selection_ids(o, F.col("o_totalprice") > 100000, ["o_orderkey"]).select("o_orderkey", "id")


@query("select p_partkey, p_partkey % 64 as cell, chr((65 + p_partkey % 8)::int) || ((p_partkey % 64) // 8 + 1) as name, p_partkey % 64 as again from part")
def cell_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's square by name, and the square of the name."""
    c = table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_partkey", F.lit(64)).alias("cell")).withColumn("name", bits.cell_name("cell", 8))
    return c.select("p_partkey", "cell", "name", bits.cell_of_name("name", 8).cast("long").alias("again"))


@query("select o_orderkey as id, case when o_orderkey % 2 = 0 then o_custkey % 3 - 1 else 1 - o_custkey % 3 end as first, 1 - o_custkey % 3 as other from orders")
def side_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from the first player's and from the other side's view."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.pmod("o_custkey", F.lit(3)) - 1).alias("value"))
    return o.select("id", bits.first_player_view("value", "id").alias("first"), bits.swap_sides("value").alias("other"))


@query("select count(*) as keys, 8::bigint as parts, 0::bigint as moved, true as even from (select distinct o_orderkey from orders)")
def hash_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition numbers depend on the key alone, and spread the keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    both = o.unionByName(o.orderBy(F.desc("key"))).withColumn("part", bits.part_of("key", 8))
    by_key = both.groupBy("key").agg(F.min("part").alias("part"), F.max("part").alias("most"))
    parts = by_key.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("part") != F.col("most")).alias("moved"))
    return parts.agg(F.sum("n").alias("keys"), F.count("*").alias("parts"), F.sum("moved").alias("moved"), (F.max("n") < 2 * F.min("n")).alias("even"))


@query("""
with s as (select distinct l_orderkey as ord, l_partkey % 8 as x1, l_suppkey % 8 as y1, l_linenumber::bigint as x2, l_quantity::bigint % 8 as y2 from lineitem)
select a.ord as "order", count(*) as pairs, count(*) filter (
  sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  and sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0) as crossing
from s a join s b on a.ord = b.ord and (a.x1, a.y1, a.x2, a.y2) < (b.x1, b.y1, b.x2, b.y2) group by 1
""")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of an order's lines cross, each a link between two points of the plane."""
    x = table(spark, sf_dir, "lineitem")
    links = x.select(F.col("l_orderkey").alias("order"), F.pmod("l_partkey", F.lit(8)).alias("x1"), F.pmod("l_suppkey", F.lit(8)).alias("y1"), F.col("l_linenumber").cast("long").alias("x2"), F.pmod(F.col("l_quantity").cast("long"), F.lit(8)).alias("y2")).distinct()
    names = ("x1", "y1", "x2", "y2")
    a, b = links.alias("a"), links.alias("b")
    of = lambda k: tuple(F.col(f"{k}.{c}") for c in names)
    pairs = a.join(b, (F.col("a.order") == F.col("b.order")) & (F.struct(*of("a")) < F.struct(*of("b"))))
    return pairs.groupBy(F.col("a.order").alias("order")).agg(F.count("*").alias("pairs"), F.count_if(bits.crossing(of("a"), of("b"))).alias("crossing"))


@query("select 8 as square, 4 as oblong, 16 as wheel")
def board_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the symmetry groups of 3 x 3 and 3 x 2 grids, and of eight points around one,
    found from their edges."""
    def grid(w: int, h: int) -> int:
        e = [(y * w + x, y * w + x + 1) for y in range(h) for x in range(w - 1)] + [(y * w + x, y * w + x + w) for y in range(h - 1) for x in range(w)]
        return len(automorphisms(w * h, e))

    wheel = len(automorphisms(9, [(i, (i + 1) % 8) for i in range(8)] + [(i, 8) for i in range(8)]))
    return spark.createDataFrame([(grid(3, 3), grid(3, 2), wheel)], "square int, oblong int, wheel int")


@query(f"with {_masks(9)}, d as (select distinct mask as block from masks), t as (select block, list_reduce(list_prepend(0::bigint, list_transform(range(9), lambda j: ((block >> j::int) & 1)::bigint)), lambda a, x: a * 2 + x) as mirror from d), b as (select block, mirror from t union select mirror, block from t) select count(*) as kept, sum(case when block = mirror then 1 else 2 end)::bigint as weight, (select count(*) from b) as blocks from b where block <= mirror")
def mirror_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' masks and their mirrors: one of each pair is kept, and the weights add up to
    all."""
    own = order_masks(spark, sf_dir, 9).select(F.col("mask").alias("block")).distinct()
    mirror = lambda df: df.withColumn("mirror", bits.permute("block", list(range(8, -1, -1))))
    b = mirror(own.unionByName(mirror(own).select(F.col("mirror").alias("block"))).distinct())
    weight = mirror_weight("block", "mirror")
    return b.agg(F.count(weight).alias("kept"), F.sum(weight).cast("long").alias("weight"), F.count("*").alias("blocks"))


@query("select l_suppkey, l_partkey, place from (select l_suppkey, l_partkey, cast(row_number() over (partition by l_suppkey order by q desc, l_partkey) as int) as place from (select l_suppkey, l_partkey, max(l_quantity) as q from lineitem group by all)) where place <= 3")
def move_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of every supplier's parts by quantity, ties by the smaller part."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return folds.ordered_moves(m, "l_suppkey", "q", "l_partkey").where("place <= 3").select("l_suppkey", "l_partkey", "place")


@query("select not exists (from ((select l_partkey from lineitem except all select l_partkey from lineitem))) as same, false as other")
def multiset_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against itself in another order, and against itself without its repeats."""
    x = table(spark, sf_dir, "lineitem").select("l_partkey")
    same, other = tables.multiset_equal(x, x.orderBy("l_partkey")), tables.multiset_equal(x, x.distinct())
    return spark.createDataFrame([(same, other)], "same boolean, other boolean")


def _step(ply: int) -> str:
    """SQL of a step of the walks."""
    mixed = f"((({ply << 40} + dst) % 2147483647) * 48271 + walk * 69621 + {ply * 16807 + 40014}) % 2147483647"
    return (
        f"w{ply} as (select walk, {ply} as ply, dst as id from (select walk, dst, row_number() over (partition by walk order by (({mixed}) * 48271) % 2147483647, dst) as k "
        f"from w{ply - 1} join e on e.layer = {ply - 1} and e.src = w{ply - 1}.id) where k = 1)"
    )


@query(f"with {_EDGES}, w0 as (select o_orderkey as walk, 0 as ply, o_orderkey as id from orders), " + ", ".join(map(_step, (1, 2, 3))) + " select walk, ply, id from w0 union all select walk, ply, id from w1 union all select walk, ply, id from w2 union all select walk, ply, id from w3")
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk from every order down to a nation."""
    far = 1 << 40
    e = supply_edges(spark, sf_dir).select((F.col("layer").cast("long") * far + F.col("src")).alias("src"), ((F.col("layer").cast("long") + 1) * far + F.col("dst")).alias("dst"))
    roots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("walk"), F.col("o_orderkey").alias("id"))
    return sampling.walks(e, roots, 3, seed=1).select("walk", "ply", F.pmod("id", F.lit(far)).alias("id"))


@query(f"""
with {boards_of(12)}, {_BREAKTHROUGH.strip()},
p as (select id, a, b, id % 2 as s from boards),
o as (select *, case when s = 0 then (b & 7) <> 0 or a = 0 else (a & (7 << 9)) <> 0 or b = 0 end as over from p),
k as (select id, count(distinct ((case when o.s = 0 then (a - f) | t else a & ~t end) | ((case when o.s = 1 then (b - f) | t else b & ~t end) << 12) | ((1 - o.s)::bigint << 24))) as children
  from o join m on m.s = o.s and ((case when o.s = 0 then a else b end) & f) <> 0 and ((case when o.s = 0 then a else b end) & t) = 0 and (diagonal or ((case when o.s = 0 then b else a end) & t) = 0)
  where not over group by id)
select o.id, a | (b << 12) | (s::bigint << 24) as state, over, coalesce(children, 0) as children from o left join k using (id)
""")
def expand_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' boards as breakthrough on 3 x 4: whether each is over, and how many different
    states a move leads to."""
    game = native.breakthrough(3, 4)
    state = F.col("a").bitwiseOR(shift("b", 12)).bitwiseOR(shift(F.pmod("id", F.lit(2)), 24))
    orders = cut(order_boards(spark, sf_dir, 12).select(F.col("id").alias("order"), state.alias("id")))
    judged = cut(game.decide(orders.select("id").distinct()))
    moves = game.children(judged.where("value is null").select("id")).groupBy("id").agg(F.count_distinct("dst").alias("children"))
    out = orders.join(judged, "id").join(moves, "id", "left")
    return out.select(F.col("order").alias("id"), F.col("id").alias("state"), F.col("value").isNotNull().alias("over"), F.coalesce("children", F.lit(0)).cast("long").alias("children"))
