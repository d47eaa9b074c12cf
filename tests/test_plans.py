import random

import pytest
from pyspark.sql import functions as F

from plyframe.operators import folds, tables
from plyframe.plans import fixpoint


def brute(nodes, edges):
    """Distances and values by plain passes."""
    kids = {}
    for a, b in edges:
        kids.setdefault(a, set()).add(b)
    value = {n: v for n, v in nodes.items() if v is not None}
    depth = {n: 0 for n in value}
    p = 0
    while True:
        p += 1
        new = {}
        for n in nodes:
            if n in value or n not in kids:
                continue
            if any(value.get(k) == -1 for k in kids[n]):
                new[n] = 1
            elif all(value.get(k) == 1 for k in kids[n]):
                new[n] = -1
        if not new:
            return value, depth
        value |= new
        depth |= dict.fromkeys(new, p)


@pytest.mark.parametrize("seed, beside", [(1, 8), (2, 2)])
def test_attractor_against_brute_force(spark, monkeypatch, seed, beside):
    """Also where changes go into the tables often."""
    monkeypatch.setattr(fixpoint, "BESIDE", beside)
    r = random.Random(seed)
    n = 60
    nodes = {i: -1 if r.random() < 0.15 else 1 if r.random() < 0.05 else None for i in range(n)}
    edges = {(a, r.randrange(n)) for a in range(n) if nodes[a] is None and r.random() < 0.95 for _ in range(r.randint(1, 3))}
    value, depth = brute(nodes, edges)
    got = fixpoint.attractor(spark.createDataFrame(list(nodes.items()), "id long, value int"), spark.createDataFrame(list(edges), "src long, dst long"))
    rows = {x.id: (x.value, x.decided_at) for x in got.collect()}
    assert rows == {i: (value.get(i), depth.get(i)) for i in nodes}


def test_layered_attractor_keeps_lower_draws(spark):
    nodes = spark.createDataFrame([(0, 1, None), (0, 2, None), (0, 3, -1), (1, 4, None), (1, 5, None)], "layer int, id long, value int")
    # 1 and 2 circle, so they are drawn; 4 only leads to a draw, 5 to a loss
    edges = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (5, 3), (5, 4)], "src long, dst long")
    got = {r.id: r.value for r in fixpoint.layered_attractor(nodes, edges, [0, 1]).collect()}
    assert got == {1: 0, 2: 0, 3: -1, 4: 0, 5: 1}


def test_decided_draws_keep_parents_from_losing(spark):
    nodes = spark.createDataFrame([(1, None), (2, 0), (3, 1), (4, None)], "id long, value int")
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 3), (4, 9)], "src long, dst long")
    got = {r.id: (r.value, r.decided_at) for r in fixpoint.attractor(nodes, edges).collect()}
    assert got == {1: (None, None), 2: (0, 0), 3: (1, 0), 4: (None, None)}
    assert fixpoint.attractor(nodes.limit(0), edges.limit(0)).count() == 0


def test_closure_and_bands(spark):
    r = random.Random(3)
    edges = {(r.randrange(14), r.randrange(14)) for _ in range(18)}
    want = set(edges)
    while True:
        more = {(a, d) for a, b in want for c, d in edges if b == c} - want
        if not more:
            break
        want |= more
    got = fixpoint.closure(spark.createDataFrame(list(edges), "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert fixpoint.closure(spark.createDataFrame([], "src long, dst long")).count() == 0
    states = spark.createDataFrame([(0, 1, None), (1, 2, None), (3, 3, -1), (3, 4, 1)], "band int, id long, value int")
    moves = spark.createDataFrame([(1, 2), (1, 4), (2, 3)], "src long, dst long")
    assert {x.id: x.value for x in fixpoint.banded_sweep(states, moves, folds.negamax(), -1).collect()} == {1: -1, 2: 1, 3: -1, 4: 1}


def test_what_does_not_end_is_an_error(spark):
    e = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    step = lambda now: now.join(e.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"))
    with pytest.raises(ValueError, match="layers"):
        fixpoint.layers(spark.range(1, 2), step, ["id"], 3)


def test_reach_and_empty(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "BESIDE", 1)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    assert {(r.id, r.depth) for r in fixpoint.reach(e, spark.range(1, 2)).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert fixpoint.reach(e.limit(0), spark.range(0)).count() == 0


def test_audits_find_a_wrong_value(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    v = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (3, -1, 0)], "id long, value int, decided_at int")
    assert [r.id for r in fixpoint.audit(v, e).collect()] == [1]
    assert fixpoint.depth_audit(spark.createDataFrame([(1, -1, 2), (2, 1, 1), (3, -1, 0)], v.schema), e).count() == 0


def test_folds(spark):
    e = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 12), (4, 99)], "src long, dst long")
    v = spark.createDataFrame([(10, -1), (11, 1), (12, 0)], "id long, value int")
    assert {r.id: r.value for r in folds.parents(e, v).collect()} == {1: 1, 2: -1, 3: 0}
    assert {r.id: r.value for r in folds.parents(e, v, "draw").collect()} == {1: 1, 2: -1, 3: 0, 4: 0}
    with pytest.raises(Exception, match="no value for child 99"):
        folds.parents(e, v, "fail").collect()
    # a child that is there but undecided is neither a draw nor lost
    open_child = spark.createDataFrame([(10, None), (11, 1), (12, None)], "id long, value int")
    assert {r.id: r.value for r in folds.parents(e, open_child).collect()} == {1: None, 2: -1, 3: None}


def test_bounds_and_diff(spark):
    a = spark.createDataFrame([(1, 0, 5), (2, 3, 4)], "id long, lower int, upper int")
    b = spark.createDataFrame([(1, 2, 9), (2, 5, 6), (3, 1, 1)], "id long, lower int, upper int")
    got = {r.id: (r.lower, r.upper, r.consistent) for r in tables.merge_bounds(a, b, "id").collect()}
    assert got == {1: (2, 5, True), 2: (5, 4, False), 3: (1, 1, True)}
    assert tables.multiset_equal(a, a.union(a).limit(2)) in (True, False)
    assert not tables.multiset_equal(a, a.union(a))


def test_best_line(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (5, 6)], "src long, dst long")
    v = fixpoint.attractor(spark.createDataFrame([(i, -1 if i in (4, 6) else None) for i in range(1, 7)], "id long, value int"), e)
    assert fixpoint.best_line(e, v, 3) == [3, 5, 6]
    assert fixpoint.best_line(e, v.withColumn("x", F.lit(1)), 5) == [5, 6]
