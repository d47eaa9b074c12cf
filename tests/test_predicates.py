import random
from itertools import combinations

import pytest

from plyframe.functions import predicates
from plyframe.functions.zdd import Zdd
from plyframe.games import native
from plyframe.plans import sampling


def test_hitting_set_against_all_subsets():
    r = random.Random(1)
    for _ in range(60):
        lines = [sum(1 << p for p in r.sample(range(8), 3)) for _ in range(r.randint(0, 5))]
        want = next(k for k in range(9) if any(all(m & x for x in lines) for m in (sum(1 << p for p in c) for c in combinations(range(8), k))))
        assert predicates.least_hitting_set(lines) == want


def test_alive_and_bounds():
    two = sum(1 << i for i, c in enumerate("OOOOOO.O.OOOOOO" + "." * 10) if c == "O")
    assert predicates.unconditionally_alive(two, 0, 5, 5) == two
    assert predicates.unconditionally_alive(two, 1 << 6, 5, 5) == two  # a stone in an eye changes nothing
    # a wall of burned cells parts the board: three free cells beside one queen, one beside the other
    burned = sum(1 << c for c in (4, 5, 6, 7, 10, 11))
    assert predicates.territory_bounds(1 << 0, 1 << 8, burned, 4, 3) == (3, 1)
    assert predicates.territory_bounds(1, 2, 0, 2, 2) == (0, 0)  # shared ground counts for nobody


def test_published_static_values():
    """Area scores of 3 x 3 boards, and how many white stones of 5 x 5 boards are alive whatever
    happens."""
    mask = lambda text, c: sum(1 << i for i, x in enumerate(text.replace("/", "")) if x == c)
    for board, score in ((".X./X.X/.X.", 9), ("XXX/XXX/XXX", 9), ("XXX/OOO/...", -3)):
        assert predicates.area_score(mask(board, "X"), mask(board, "O"), 3, 3) == score
    for board, alive in (("OOOOO/O.O.O/OOOOO/...../.....", 13), ("OOOOO/O...O/OOOOO/...../.....", 0)):
        assert predicates.unconditionally_alive(mask(board, "O"), 0, 5, 5).bit_count() == alive


@pytest.mark.parametrize("n,seed", [(6, 1), (10, 2)])
def test_zdd(spark, n, seed):
    r = random.Random(seed)
    family = sorted({r.randrange(1 << n) for _ in range(2 * n)})
    z = Zdd.of(family, n)
    order = sorted(family, key=lambda m: [m >> i & 1 for i in range(n)])
    assert [z.unrank(k) for k in range(len(order))] == order
    assert [z.rank(m) for m in order] == list(range(len(order)))
    assert all(z.rank(m) is None for m in range(1 << n) if m not in family)
    back = Zdd.load(z.table(spark))
    assert [x.mask for x in back.scan(spark).orderBy("rank").collect()] == order
    with pytest.raises(IndexError):
        z.unrank(len(order))
    assert len(Zdd.of([], 4)) == 0 and Zdd.of([0], 4).rank(0) == 0


def test_playouts_follow_the_rules(spark):
    game = native.breakthrough(2, 4)
    rows = sampling.playouts(spark, game, 8, seed=3).orderBy("game", "ply").collect()
    again = sampling.playouts(spark, game, 8, seed=3).orderBy("game", "ply").collect()
    assert rows == again
    last = {}
    for x in rows:
        if x.ply:
            children = {c.dst for c in game.children(spark.createDataFrame([(last[x.game],)], "id long")).collect()} if x.game == 0 else {x.id}
            assert x.id in children
        last[x.game] = x.id
    ends = spark.createDataFrame([(i,) for i in set(last.values())], "id long")
    assert game.decide(ends).where("value is null").join(game.children(ends), "id", "left_semi").count() == 0
