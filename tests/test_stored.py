"""Bitmaps, parts and stored layers against plain versions."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from plyframe.functions import bits
from plyframe.operators import folds, stored
from plyframe.persist import cut
from plyframe.plans import bitmaps, demand, fixpoint, partwise, refinement
from plyframe.plans.journal import COMMITTING, EXPANDING, READY, Journal, Stopped, stop_at


def test_maps_hold_numbers(spark):
    r = random.Random(1)
    ids = {0, 1, -1, 32767, 32768, 32769, -32768, -32767, 1 << 40, *(r.randint(-200_000, 200_000) for _ in range(300))}
    df = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id long")
    assert sorted(x.id for x in bitmaps.ids_of(bitmaps.maps_of(df)).collect()) == sorted(ids)
    some = {i for i in ids if i % 2}
    rest = bitmaps.without(bitmaps.maps_of(df), bitmaps.maps_of(df.where("id % 2 <> 0")))
    assert {x.id for x in bitmaps.ids_of(rest).collect()} == ids - some
    assert bitmaps.maps_of(df.limit(0)).count() == 0


@pytest.mark.parametrize("few, beside", [(2048, 8), (-1, 2)])
def test_reach_by_maps(spark, monkeypatch, few, beside):
    """Also with the frontier shuffled, and the seen set written often."""
    monkeypatch.setattr(bitmaps, "FEW_MAPS", few)
    monkeypatch.setattr(bitmaps, "BESIDE", beside)
    r = random.Random(2)
    far = lambda: r.choice([r.randint(-30, 30), r.randint(100_000, 100_030)])
    edges = spark.createDataFrame([(far(), far()) for _ in range(110)] + [(None, 1), (1, None)], "src long, dst long")
    roots = spark.createDataFrame([(5,), (7,), (100_003,), (999,)], "id long")
    want = {(x.id, x.depth) for x in fixpoint.reach(edges.where("src is not null and dst is not null"), roots).collect()}
    got = [(x.id, x.depth) for x in bitmaps.ids_of(bitmaps.reach_maps(edges, roots)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(d for _, d in want) > 3
    near = bitmaps.ids_of(bitmaps.reach_maps(edges, roots, 2)).collect()
    assert {(x.id, x.depth) for x in near} == {w for w in want if w[1] <= 2}
    assert bitmaps.reach_maps(edges.limit(0), roots.limit(0)).count() == 0


def test_reach_by_maps_goes_on(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    name = f"test-{uuid.uuid4().hex}"
    for number, phase in ((1, READY), (4, COMMITTING), (7, EXPANDING)):
        with pytest.raises(Stopped):
            bitmaps.reach_maps(edges, spark.range(1), journal=Journal(spark, name, stop_at(number, phase)))
    j = Journal(spark, name)
    assert {(x.id, x.depth) for x in bitmaps.ids_of(bitmaps.reach_maps(edges, spark.range(1), journal=j)).collect()} == {(i, i) for i in range(13)}
    j.drop()


def layered(spark, seed):
    r = random.Random(seed)
    edges = {(k, r.randrange(30), r.randrange(30)) for k in range(3) for _ in range(60)}
    leaves = [(i, r.choice([-1, 0, 1])) for i in range(25)]  # some children have no value
    return spark.createDataFrame(sorted(edges), "layer int, src long, dst long"), spark.createDataFrame(leaves, "id long, value int")


def test_sweep_in_parts_goes_on_with_the_missing_ones(spark):
    edges, leaves = layered(spark, 3)
    want = sorted(map(tuple, fixpoint.sweep(edges, leaves, folds.negamax(), 3).collect()))
    name = f"test-{uuid.uuid4().hex}"
    for number, phase in ((3, READY), (6, COMMITTING), (8, EXPANDING)):
        with pytest.raises(Stopped):
            partwise.sweep_in_parts(edges, leaves, 3, 3, Journal(spark, name, stop_at(number, phase)))
    j = Journal(spark, name)
    done = len(j.steps)
    assert done == 8 and sorted(map(tuple, partwise.sweep_in_parts(edges, leaves, 3, 3, j).collect())) == want
    parts = [(s.notes["layer"], s.notes["part"]) for s in j.steps if "part" in s.notes]
    assert parts == [(k, p) for k in (2, 1, 0) for p in range(3)]  # each once
    j.drop()
    assert partwise.sweep_in_parts(edges.limit(0), leaves.limit(0), 3, 2).count() == 0


def files_read(spark, df):
    """What the scans of the last query read: {files, partitions} of the scan with partitions."""
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, each, nodes = {}, store.executionMetrics(last).iterator(), store.planGraph(last).allNodes()
    while each.hasNext():
        pair = each.next()
        values[pair._1()] = pair._2()
    for k in range(nodes.size()):
        metrics = nodes.apply(k).metrics()
        got = {}
        for m in range(metrics.size()):
            x = metrics.apply(m)
            if x.accumulatorId() in values:
                got[x.name()] = values[x.accumulatorId()]
        if "number of partitions read" in got:
            return {"files": int(got["number of files read"]), "partitions": int(got["number of partitions read"])}
    return {"files": 0, "partitions": 0}  # where nothing is asked for, no scan is left


def test_lookup_reads_the_layers_that_its_rows_ask_for(spark):
    values = spark.createDataFrame([(k, i, i % 3 - 1) for k in range(6) for i in range(40)], "layer int, id long, value int").repartition(4)
    table = stored.in_layers(values)
    every = len(table.inputFiles())
    for asked in ([1], [0, 3], []):
        edges = cut(spark.createDataFrame([(k, 100 + i, i) for k in asked for i in range(50)], "layer int, src long, dst long"))
        got = stored.layer_lookup(edges, table)
        assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted((k, 100 + i, i, i % 3 - 1) for k in asked for i in range(40))
        seen = files_read(spark, got)
        assert seen["partitions"] == len(asked) and seen["files"] == every * len(asked) // 6


def cyclic(seed, n=60):
    r = random.Random(seed)
    nodes = [(i, r.choice([-1, -1, 1, 0]) if r.random() < 0.25 else None) for i in range(n)]
    edges = {(a, r.randrange(n)) for a, v in nodes if v is None for _ in range(r.randint(0, 3))}
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_asked_values_are_those_of_the_whole_graph(spark, seed):
    rows, pairs = cyclic(seed)
    nodes = spark.createDataFrame(rows, "id long, value int")
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = {x.id: (x.value, x.decided_at) for x in fixpoint.attractor(nodes, edges).collect()}
    asked = [3, 7, 7, 20, 999]
    got, met = demand.evaluate(spark.createDataFrame([(i,) for i in asked], "id long"), nodes, edges)
    assert {x.id: (x.value, x.decided_at) for x in got.collect()} == {i: want[i] for i in (3, 7, 20)}
    # met by hand: children of open states, of those with a lost child only the lost ones
    value, kids = dict(rows), {}
    for a, b in pairs:
        kids.setdefault(a, []).append(b)
    seen, todo = set(), [3, 7, 20]
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        if value[at] is None:
            below = kids.get(at, [])
            todo += [b for b in below if value[b] == -1] or below
    assert met == len(seen) < len(rows)
    none, met = demand.evaluate(nodes.where("id < 0").select("id"), nodes, edges)
    assert none.count() == 0 and met == 0


def plain_refine(edges, rounds):
    nodes = {x for e in edges for x in e}
    colour = dict.fromkeys(nodes, 0)
    for _ in range(rounds):
        sign = {x: (colour[x], tuple(sorted(colour[b] for a, b in edges if a == x)), tuple(sorted(colour[a] for a, b in edges if b == x))) for x in nodes}
        first = {}
        for x in sorted(nodes):
            first.setdefault(sign[x], x)
        if len(set(first.values())) == len(set(colour.values())) and _:
            return {x: first[sign[x]] for x in nodes}
        colour = {x: first[sign[x]] for x in nodes}
    return colour


@pytest.mark.parametrize("rounds", [1, 2, None])
def test_refinement_against_plain_colours(spark, rounds):
    r = random.Random(6)
    edges = [(r.randrange(20), r.randrange(20)) for _ in range(26)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 301), (301, 302), (302, 300), (400, 400)]
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "src long, dst long")
    got = {x.id: x["class"] for x in refinement.refine(df, rounds).collect()}
    assert got == plain_refine(edges, 50 if rounds is None else rounds)
    assert refinement.refine(df.limit(0)).count() == 0


def test_classes_hold_the_symmetries_of_a_board(spark):
    """The squares of a three by three board: corner, edge and middle."""
    near = [(3 * y + x, 3 * v + u) for y in range(3) for x in range(3) for v in range(3) for u in range(3) if abs(x - u) + abs(y - v) == 1]
    got = {x.id: x["class"] for x in refinement.refine(spark.createDataFrame(near, "src long, dst long")).collect()}
    assert got == {0: 0, 2: 0, 6: 0, 8: 0, 1: 1, 3: 1, 5: 1, 7: 1, 4: 4}


def test_hashes_of_sets_follow_their_changes(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3), (2, "c", 4)], "g int, x string, n int")
    item = bits.item_hash("x", "n")
    whole = {r.g: r.h for r in df.groupBy("g").agg(bits.set_hash(item).alias("h")).collect()}
    back = {r.g: r.h for r in df.orderBy(F.desc("n")).groupBy("g").agg(bits.set_hash(item).alias("h")).collect()}
    assert whole == back and whole[1] != whole[2]
    one = {r.n: r.h for r in df.select("n", item.alias("h")).collect()}
    assert len(set(one.values())) == 4
    row = spark.createDataFrame([(whole[1], one[2], None), (None, None, one[4])], "old long, removed long, added long")
    assert [r[0] for r in row.select(bits.updated_hash("old", "removed", "added")).collect()] == [one[1] ^ one[3], whole[2]]


def test_parts_without_open_nodes_are_not_read_again(spark, monkeypatch):
    """A chain through five parts: the one at its end is decided first."""
    n = 50
    nodes = spark.createDataFrame([(i, -1 if i == n - 1 else None) for i in range(n)], "id long, value int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    want = sorted(map(tuple, fixpoint.attractor(nodes, edges, 22).collect()), key=str)
    seen, commit = [], Journal.commit

    def counted(self, given, *args, **notes):
        out = commit(self, given, *args, **notes)
        if "moved" in given:
            seen.append(files_read(spark, None))
        return out

    monkeypatch.setattr(Journal, "commit", counted)
    got = fixpoint.attractor(nodes, edges, 22, part=F.floor(F.col("id") / 10))
    parts = [x["partitions"] for x in seen]
    assert len(parts) == 22 and parts[0] == 5 and parts[-1] == 3 and parts == sorted(parts, reverse=True)
    assert sorted(map(tuple, got.collect()), key=str) == want
    with pytest.raises(ValueError, match="parts"):
        monkeypatch.setattr(fixpoint, "PARTS", 3)
        fixpoint.attractor(nodes, edges, part=F.floor(F.col("id") / 10))
