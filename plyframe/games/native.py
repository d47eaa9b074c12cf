"""Boards whose moves are built-in expressions over bit masks: no Python runs on a state."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.functions.bits import lines_of_four
from plyframe.functions.symmetry import canonical, grid_symmetries
from plyframe.games.core import Game, settle


def _field(id: str, at: int, width: int):
    return F.shiftrightunsigned(F.col(id), at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _join(*parts):
    """One LONG of (column, offset) pairs."""
    out = F.lit(0).cast("long")
    for c, at in parts:
        out = out.bitwiseOR(F.shiftleft(c.cast("long"), at))
    return out


def connect4(w: int, h: int) -> Game:
    """Four in a row on w columns of height h; one spare cell above each column."""
    n, step = w * (h + 1), h + 1

    def decode(s: DataFrame) -> DataFrame:
        return settle(s, a=_field("id", 0, n), b=_field("id", n, n))

    def children(s: DataFrame) -> DataFrame:
        s = settle(decode(s), occ=F.col("a").bitwiseOR(F.col("b")))
        cols = F.array(*[F.struct(F.lit(1 << c * step).cast("long").alias("low"), F.lit(((1 << h) - 1) << c * step).cast("long").alias("all")) for c in range(w)])
        s = s.withColumn("c", F.explode(cols)).withColumn("new", (F.col("occ").bitwiseAND(F.col("c.all")) + F.col("c.low")).bitwiseAND(F.col("c.all")))
        return s.where("new <> 0").select("id", _join((F.col("b"), 0), (F.col("a").bitwiseOR(F.col("new")), n)).alias("dst"))

    def decide(s: DataFrame) -> DataFrame:
        full = F.bit_count(F.col("a").bitwiseOR(F.col("b"))) == w * h
        return decode(s).select("id", F.when(lines_of_four("b", [1, step, step + 1, step - 1]), -1).when(full, 0).alias("value"))

    return Game(f"connect4 {w}x{h}", (0,), children, decide, 0, acyclic=True)


def breakthrough(w: int, h: int, rows: int = 2) -> Game:
    """Pawns go one step ahead, straight to an empty cell or diagonally to one without an
    own pawn; a pawn on the far row or the last capture wins, no move loses."""
    n = w * h
    white = (1 << rows * w) - 1
    black = white << (h - rows) * w
    top, bottom = ((1 << w) - 1) << (h - 1) * w, (1 << w) - 1
    moves = [
        (s, 1 << (y * w + x), 1 << ((y + (1, -1)[s]) * w + x + dx), dx != 0)
        for s, y, x, dx in product((0, 1), range(h), range(w), (-1, 0, 1))
        if 0 <= y + (1, -1)[s] < h and 0 <= x + dx < w
    ]

    def decode(s: DataFrame) -> DataFrame:
        return settle(s, a=_field("id", 0, n), b=_field("id", n, n), s=_field("id", 2 * n, 1))

    def children(s: DataFrame) -> DataFrame:
        s = settle(decode(s), own=F.when(F.col("s") == 0, F.col("a")).otherwise(F.col("b")), opp=F.when(F.col("s") == 0, F.col("b")).otherwise(F.col("a")))
        table = s.sparkSession.createDataFrame(moves, "ms long, f long, t long, diagonal boolean")
        ok = (F.col("s") == F.col("ms")) & (F.col("own").bitwiseAND(F.col("f")) != 0) & (F.col("own").bitwiseAND(F.col("t")) == 0) & (F.col("diagonal") | (F.col("opp").bitwiseAND(F.col("t")) == 0))
        s = s.join(F.broadcast(table), ok)
        own, opp = F.col("own").bitwiseXOR(F.col("f")).bitwiseOR(F.col("t")), F.col("opp").bitwiseAND(F.bitwise_not(F.col("t")))
        a, b = F.when(F.col("s") == 0, own).otherwise(opp), F.when(F.col("s") == 0, opp).otherwise(own)
        return s.select("id", _join((a, 0), (b, n), (1 - F.col("s"), 2 * n)).alias("dst"))

    def decide(s: DataFrame) -> DataFrame:
        lost_white = (F.col("b").bitwiseAND(F.lit(bottom).cast("long")) != 0) | (F.col("a") == 0)
        lost_black = (F.col("a").bitwiseAND(F.lit(top).cast("long")) != 0) | (F.col("b") == 0)
        return decode(s).select("id", F.when(F.when(F.col("s") == 0, lost_white).otherwise(lost_black), -1).alias("value"))

    return Game(f"breakthrough {w}x{h}", (white | black << n,), children, decide, -1)


def breakthrough_positions(spark: SparkSession, w: int, h: int, rows: int = 2) -> DataFrame:
    """(a, b): every placement with pawns on both sides, at most as many as at the start, and
    none on its far row; with either side to move these are the states of a full table."""
    n, free = rows * w, (h - 1) * w
    both = spark.range(1 << 2 * free).select(F.col("id").bitwiseAND(F.lit((1 << free) - 1)).alias("a"), F.shiftleft(F.shiftright("id", free), w).alias("b"))
    sized = (F.bit_count("a").between(1, n)) & (F.bit_count("b").between(1, n))
    return both.where((F.col("a").bitwiseAND(F.col("b")) == 0) & sized)


def _ray(w: int, h: int, cell: int, dx: int, dy: int) -> list[int]:
    x, y, out = cell % w, cell // w, []
    while 0 <= (x := x + dx) < w and 0 <= (y := y + dy) < h:
        out.append(y * w + x)
    return out


_EIGHT = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def one_queen(w: int, h: int) -> Game:
    """Amazons with one queen a side, from every placement: move the queen, then burn a
    cell it sees; no move loses. States are the side to move's queen, the other's and the
    burned cells, the least over the board's symmetries."""
    n = w * h
    perms = grid_symmetries(w, h)
    reach = []  # from, to, cells that must be free
    for c, (dx, dy) in product(range(n), _EIGHT):
        path = 0
        for t in _ray(w, h, c, dx, dy):
            path |= 1 << t
            reach.append((1 << c, 1 << t, path))

    def decode(s: DataFrame) -> DataFrame:
        return settle(s, a=_field("id", 0, n), b=_field("id", n, n), x=_field("id", 2 * n, n))

    def pack(s: DataFrame, a, b, x, name: str) -> DataFrame:
        s = settle(s, na=a, nb=b, nx=x)
        s = settle(s, k=canonical(["na", "nb", "nx"], perms))
        return s.withColumn(name, _join((F.col("k.m0"), 0), (F.col("k.m1"), n), (F.col("k.m2"), 2 * n)))

    def children(s: DataFrame) -> DataFrame:
        rays = s.sparkSession.createDataFrame(reach, "f long, t long, path long")
        go = rays.select(F.col("f").alias("a"), "t", "path")
        shot = rays.select(F.col("f").alias("t"), F.col("t").alias("arrow"), F.col("path").alias("flight"))
        s = settle(decode(s), shut=F.col("b").bitwiseOR(F.col("x")))
        s = s.join(F.broadcast(go), "a").where(F.col("path").bitwiseAND(F.col("shut")) == 0)
        s = s.join(F.broadcast(shot), "t").where(F.col("flight").bitwiseAND(F.col("shut")) == 0)
        return pack(s, F.col("b"), F.col("t"), F.col("x").bitwiseOR(F.col("arrow")), "dst").select("id", "dst").distinct()

    def decide(s: DataFrame) -> DataFrame:
        return s.select("id", F.lit(None).cast("int").alias("value"))

    def least(a: int, b: int) -> int:
        return min((1 << p[a], 1 << p[b]) for p in perms)

    roots = sorted({least(a, b) for a in range(n) for b in range(n) if a != b})
    return Game(f"amazons one queen {w}x{h}", tuple(a | b << n for a, b in roots), children, decide, -1, acyclic=True)


#: three men's morris: eight points around a centre, in order round the edge
MORRIS3_EDGES = [(i, (i + 1) % 8) for i in range(8)] + [(i, 8) for i in range(8)]
MORRIS3_MILLS = [(0, 1, 2), (2, 3, 4), (4, 5, 6), (6, 7, 0), (0, 8, 4), (1, 8, 5), (2, 8, 6), (3, 8, 7)]


def morris3(colours: bool = False) -> Game:
    """Three men a side are placed, then slid along lines; a mill takes an enemy man that
    stands in no mill, or any if all do. With all men placed, the side to
    move loses with fewer than three or no move. States are
    side to move first; colours keeps states apart by the colour to move."""
    n = 9
    mills = [sum(1 << p for p in m) for m in MORRIS3_MILLS]
    near = {p: [b if a == p else a for a, b in MORRIS3_EDGES if p in (a, b)] for p in range(n)}
    slide = [(1 << f, 1 << t) for f in range(n) for t in near[f]]
    place = [(0, 1 << t) for t in range(n)]

    def in_mills(c):
        out = F.lit(0).cast("long")
        for m in mills:
            out = out.bitwiseOR(F.when(c.bitwiseAND(F.lit(m).cast("long")) == m, F.lit(m)).otherwise(0).cast("long"))
        return out

    def decode(s: DataFrame) -> DataFrame:
        return settle(s, a=_field("id", 0, n), b=_field("id", n, n), ha=_field("id", 2 * n, 2), hb=_field("id", 2 * n + 2, 2))

    def children(s: DataFrame) -> DataFrame:
        table = s.sparkSession.createDataFrame([(True, *m) for m in place] + [(False, *m) for m in slide], "placing boolean, f long, t long")
        s = decode(s)
        ok = (F.col("placing") == (F.col("ha") > 0)) & (F.col("a").bitwiseAND(F.col("f")) == F.col("f")) & (F.col("a").bitwiseOR(F.col("b")).bitwiseAND(F.col("t")) == 0)
        s = settle(s.join(F.broadcast(table), ok), na=F.col("a").bitwiseXOR(F.col("f")).bitwiseOR(F.col("t")))
        s = settle(s, mill=in_mills(F.col("na")).bitwiseAND(F.col("t")) != 0, safe=in_mills(F.col("b")))
        open_ = F.col("b").bitwiseAND(F.bitwise_not(F.col("safe")))
        s = settle(s, take=F.when(F.col("mill"), F.when(open_ != 0, open_).otherwise(F.col("b"))).otherwise(F.lit(0).cast("long")))
        one = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(n)]), lambda m: F.col("take").bitwiseAND(m) != 0)
        s = s.withColumn("gone", F.explode(F.when(F.col("take") == 0, F.array(F.lit(0).cast("long"))).otherwise(one)))
        hand = F.col("ha") - F.col("placing").cast("long")
        turn = 1 - _field("id", 2 * n + 4, 1) if colours else F.lit(0)
        return s.select("id", _join((F.col("b").bitwiseXOR(F.col("gone")), 0), (F.col("na"), n), (F.col("hb"), 2 * n), (hand, 2 * n + 2), (turn, 2 * n + 4)).alias("dst")).distinct()

    def decide(s: DataFrame) -> DataFrame:
        return decode(s).select("id", F.when(F.col("ha") + F.col("hb") > 0, None).when(F.bit_count("a") < 3, -1).alias("value"))

    return Game("morris 3", (3 << 2 * n | 3 << 2 * n + 2,), children, decide, -1)


def nocca(w: int, h: int) -> Game:
    """Pieces stack up to three high; the top one moves to a neighbour. Leaving the board
    from the far row wins, no move loses. A cell is four bits: a leading one, then the
    pieces from bottom to top, one for the side to move. The board turns with the move."""
    cells = w * h
    lost = 1 << 62  # what a winning exit leads to
    moves = []
    for c, (dx, dy) in product(range(cells), _EIGHT):
        x, y = c % w + dx, c // w + dy
        if 0 <= x < w and 0 <= y < h:
            moves.append((4 * c, 4 * (y * w + x)))
    root = sum((3 if c < w else 2 if c >= cells - w else 1) << 4 * c for c in range(cells))

    def digit(i: str, at):
        return F.call_function("shiftrightunsigned", F.col(i), at.cast("int")).bitwiseAND(F.lit(15).cast("long"))

    def turned(name: str):
        out = []
        for c in range(cells):
            d = _field(name, 4 * c, 4)
            other = F.when(d >= 8, d.bitwiseXOR(F.lit(7).cast("long"))).when(d >= 4, d.bitwiseXOR(F.lit(3).cast("long"))).when(d >= 2, d.bitwiseXOR(F.lit(1).cast("long"))).otherwise(d)
            out.append((other, 4 * ((h - 1 - c // w) * w + c % w)))
        return _join(*out)

    def children(s: DataFrame) -> DataFrame:
        out = [F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in moves]
        far = F.lit(False)
        for c in range(cells - w, cells):
            d = _field("id", 4 * c, 4)
            far = far | ((d > 1) & (d.bitwiseAND(F.lit(1).cast("long")) == 1))
        exits = s.where(far).select("id", F.lit(lost).alias("dst"))
        s = s.where(~far).withColumn("m", F.explode(F.array(*out))).select("id", "m.f", "m.t")
        s = settle(s, from_=digit("id", F.col("f")), to=digit("id", F.col("t")))
        s = s.where((F.col("from_") > 1) & (F.col("from_").bitwiseAND(F.lit(1).cast("long")) == 1) & (F.col("to") < 8))
        up = lambda c, at: F.call_function("shiftleft", c, at.cast("int"))
        after = F.col("id") - up(F.col("from_"), F.col("f")) + up(F.shiftright("from_", 1), F.col("f")) - up(F.col("to"), F.col("t")) + up(2 * F.col("to") + 1, F.col("t"))
        s = settle(s, after=after)
        return s.select("id", turned("after").alias("dst")).unionByName(exits)

    def decide(s: DataFrame) -> DataFrame:
        return s.select("id", F.when(F.col("id") == lost, -1).alias("value"))

    return Game(f"nocca {w}x{h}", (root,), children, decide, -1)


def chinese_checkers(m: int) -> Game:
    """One piece a side on an m x m rhombus: a step, or a hop over the other piece. The far
    corner is the goal; states whose mover already stands there are left out. All states
    are roots. The board turns with the move."""
    n = m * m
    order = sorted(((x, y) for x in range(m) for y in range(m)), key=lambda p: (p[0] + p[1], p[0]))
    at = {p: i for i, p in enumerate(order)}
    six = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
    steps, hops = [], []
    for (x, y), i in at.items():
        for dx, dy in six:
            j, k = at.get((x + dx, y + dy)), at.get((x + 2 * dx, y + 2 * dy))
            if j is not None:
                steps.append((i, j))
                if k is not None:
                    hops.append((i, j, k))

    def decode(s: DataFrame) -> DataFrame:
        return settle(s, a=_field("id", 0, 6), b=_field("id", 6, 6))

    def children(s: DataFrame) -> DataFrame:
        spark = s.sparkSession
        s = decode(s)
        step = s.join(F.broadcast(spark.createDataFrame(steps, "a long, t long")), "a").where("t <> b")
        hop = s.join(F.broadcast(spark.createDataFrame(hops, "a long, b long, t long")), ["a", "b"])
        both = step.select("id", "b", "t").unionByName(hop.select("id", "b", "t"))
        out = both.select("id", _join((n - 1 - F.col("b"), 0), (n - 1 - F.col("t"), 6)).alias("dst"))
        return out.where(F.col("dst").bitwiseAND(F.lit(63).cast("long")) != n - 1)

    def decide(s: DataFrame) -> DataFrame:
        return decode(s).select("id", F.when(F.col("b") == 0, -1).alias("value"))

    roots = tuple(a | b << 6 for a in range(n - 1) for b in range(n) if a != b)
    return Game(f"chinese checkers {m}x{m}/1", roots, children, decide, -1)


__all__ = ["breakthrough", "chinese_checkers", "connect4", "morris3", "nocca", "one_queen"]
