from itertools import combinations
from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyframe.functions import bits, ranking, symmetry
from plyframe.functions.encodings import from_black, from_winner, mover_value


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_bit_basics(spark):
    got = values(
        spark, [(0b1011,), (0,), (1 << 62,)], "m long", bits.popcount("m"), bits.lowest_bit("m"), bits.lowest_cell("m"), bits.clear_lowest("m"), bits.cells("m", 63)
    )
    assert got == [(3, 1, 0, 0b1010, [0, 1, 3]), (0, 0, None, 0, []), (1, 1 << 62, 62, 0, [62])]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, (1 << 36) - 1), min_size=1, max_size=20))
def test_permute_gather_scatter(spark, masks):
    perm = symmetry.grid_symmetries(6, 6)[5]
    picked = 0x5A5A5A5A5
    got = values(spark, [(m,) for m in masks], "m long", bits.permute("m", perm), bits.gather("m", picked), bits.scatter(bits.gather("m", picked), picked))
    at = [i for i in range(36) if picked >> i & 1]
    for m, (p, g, s) in zip(masks, got):
        assert p == sum(1 << perm[i] for i in range(36) if m >> i & 1)
        assert g == sum(1 << k for k, i in enumerate(at) if m >> i & 1)
        assert s == m & picked


def test_pack_names_crossing(spark):
    got = values(spark, [(228,)], "k long", bits.unpack("k", 4, 5), bits.pack(bits.unpack("k", 4, 5), 4), bits.cell_name(F.lit(7), 3), bits.cell_of_name(F.lit("B3"), 3))
    assert got == [([0, 1, 2, 3, 0], 228, "B3", 7)]
    seg = lambda *v: tuple(F.lit(x) for x in v)
    got = values(spark, [(1,)], "k long", bits.crossing(seg(0, 0, 2, 1), seg(1, 0, 0, 2)), bits.crossing(seg(0, 0, 2, 1), seg(0, 0, 1, 2)))
    assert got == [(True, False)]


def test_flood(spark):
    board = 0b1011_1001_1111  # 4 x 3
    got = values(spark, [(1, board), (1 << 9, board), (1 << 5, board)], "s long, m long", bits.flood("s", "m", 4, 3))
    assert [g[0] for g in got] == [0b1011_1001_1111 & ~(1 << 9) | (board & 1 << 9 and 1 << 9), board, 0]


def test_colex(spark):
    sets = sorted(combinations(range(7), 3), key=lambda c: c[::-1])
    got = values(spark, [(list(c),) for c in sets], "c array<int>", ranking.colex_rank("c", 7, 3))
    assert [g[0] for g in got] == list(range(comb(7, 3)))
    block = 0b0010010
    free = [c for c in combinations([i for i in range(7) if not block >> i & 1], 2)]
    got = values(spark, [(list(c), block) for c in free], "c array<int>, b long", ranking.restricted_rank("c", "b", 7, 2))
    assert sorted(g[0] for g in got) == list(range(comb(5, 2)))


def test_dense_ids_number_every_row(spark):
    df = spark.range(0, 500).select((F.col("id") * 37 % 101).alias("k"))
    rows = ranking.dense_ids(df, ["k"]).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(500))
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_automorphisms():
    edges = [(i, (i + 1) % 6) for i in range(6)]
    assert sorted(symmetry.automorphisms(6, edges)) == sorted(symmetry.brute_automorphisms(6, edges))
    assert len(symmetry.grid_symmetries(3, 2)) == 4


@pytest.mark.parametrize("kind,codes,want", [("morris", [0, 1, 2, 3], [None, -1, 0, 1]), ("chinese checkers", [0, 1, 2, 3], [0, 1, -1, None])])
def test_encodings(spark, kind, codes, want):
    assert [v[0] for v in values(spark, [(c,) for c in codes], "c int", mover_value("c", kind))] == want


def test_perspectives(spark):
    got = values(spark, [(0, 0, True), (1, 0, True), (2, 0, False), (1, 1, False)], "c int, t int, b boolean", from_winner("c", "t"), from_black("c", "b"))
    assert got == [(0, None), (1, 1), (-1, 1), (-1, -1)]


def test_table_function(spark):
    from plyframe.functions.udtf import register

    register(spark, "halves", lambda n: [n // 2, n - 1] if n else [])
    spark.createDataFrame([(4,), (0,)], "id long").createOrReplaceTempView("some_states")
    rows = spark.sql("select s.id, m.dst from some_states s, lateral halves(s.id) m order by 1, 2").collect()
    assert [tuple(r) for r in rows] == [(4, 2), (4, 3)]
