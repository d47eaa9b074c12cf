"""Boards against plain-Python solvers of their own, and published counts."""

from plyframe.games import native, scripted
from plyframe.games.core import explore, solve, summary


def negamax(state, moves, terminal, stuck, memo):
    if state in memo:
        return memo[state]
    t = terminal(state)
    if t is None:
        kids = moves(state)
        t = max((-negamax(k, moves, terminal, stuck, memo) for k in kids), default=stuck)
    memo[state] = t
    return t


def test_connect4_small_board(spark):
    w = h = 3

    def moves(s):
        cols, turn = s
        return [(tuple(c + (turn,) if i == k else c for i, c in enumerate(cols)), 1 - turn) for k in range(w) if len(cols[k]) < h]

    def terminal(s):
        return 0 if all(len(c) == h for c in s[0]) else None  # three rows hold no four

    memo = {}
    root = negamax((((),) * w, 0), moves, terminal, 0, memo)
    got = summary(spark, native.connect4(w, h)).first()
    assert (got.states, got.root_value) == (len({tuple(map(tuple, c)) for c, _ in memo}), root)


def test_breakthrough(spark):
    w, h = 2, 4

    def moves(s):
        own, opp, up = s
        out = []
        for x, y in own:
            for dx in (-1, 0, 1):
                t = (x + dx, y + up)
                if 0 <= t[0] < w and 0 <= t[1] < h and t not in own and (dx or t not in opp):
                    out.append((opp - {t}, own - {(x, y)} | {t}, -up))
        return out

    def terminal(s):
        own, opp, up = s
        home = 0 if up == 1 else h - 1
        return -1 if not own or any(y == home for _, y in opp) else None

    white = frozenset((x, y) for x in range(w) for y in (0, 1))
    black = frozenset((x, y) for x in range(w) for y in (2, 3))
    memo = {}
    root = negamax((white, black, 1), moves, terminal, -1, memo)
    got = summary(spark, native.breakthrough(w, h)).first()
    assert got.root_value == root
    reached, todo = {(white, black, 1)}, [(white, black, 1)]
    while todo:
        s = todo.pop()
        if terminal(s) is None:
            new = set(moves(s)) - reached
            reached |= new
            todo += new
    assert got.states == len(reached)
    assert got.wins == sum(negamax(s, moves, terminal, -1, memo) == 1 for s in reached)


def test_morris_reaches_published_states(spark):
    got = summary(spark, native.morris3(colours=True)).first()
    assert (got.states, got.root_value) == (5934, 1)


def test_one_queen_values_are_consistent(spark):
    v = {r.id: r.value for r in solve(spark, native.one_queen(2, 2)).collect()}
    assert sorted(v.values()) == [-1] * 4 + [1] * 3


def test_othello_and_pentago_and_go(spark):
    s = summary(spark, scripted.go(1, 2, 4)).first()
    assert s.states > 5 and s.root_value in (-1, 0, 1)
    nodes, edges = explore(spark, scripted.pentago(4), 1)
    # one stone after one turn may lie on any cell
    assert (nodes.count(), edges.count()) == (17, 16)
    nodes, _ = explore(spark, scripted.othello(4), 2)
    assert [r["count"] for r in nodes.groupBy("depth").count().orderBy("depth").collect()] == [1, 4, 12]


def test_animal_shogi_first_moves(spark):
    nodes, edges = explore(spark, scripted.animal_shogi(), 1)
    # chick takes chick, giraffe up, lion to either side
    assert edges.count() == 4
    assert nodes.where("value is not null").count() == 0


def test_twixt_edges():
    assert scripted.twixt(3, 3).acyclic
    try:
        scripted.twixt(6, 6)
    except ValueError as e:
        assert "63 bits" in str(e)
    else:
        raise AssertionError("too large a board must be refused")
