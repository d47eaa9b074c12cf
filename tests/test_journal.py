"""Runs that are broken off and taken up again, and tables in buckets."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from plyframe.plans import fixpoint
from plyframe.plans.journal import COMMITTING, EXPANDING, READY, Journal, Stopped, in_buckets, stop_at


def graph(seed, n=50):
    r = random.Random(seed)
    edges = sorted({(a, r.randrange(n)) for a in range(n) for _ in range(r.randint(0, 2))} | {(i, i + 1) for i in range(n, n + 12)} | {(0, n)})
    nodes = [(i, -1 if r.random() < 0.2 else None) for i in range(n + 13)]
    return nodes, edges


@pytest.fixture(scope="module")
def tables(spark):
    nodes, edges = graph(4)
    return spark.createDataFrame(nodes, "id long, value int"), spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("what, phase", [("reach", READY), ("reach", COMMITTING), ("attractor", EXPANDING), ("attractor", COMMITTING)])
def test_a_run_goes_on_where_it_was_broken_off(spark, tables, monkeypatch, phase, what):
    monkeypatch.setattr(fixpoint, "BESIDE", 2)
    nodes, edges = tables
    run = (lambda j=None: fixpoint.reach(edges, spark.range(1), journal=j)) if what == "reach" else (lambda j=None: fixpoint.attractor(nodes, edges, journal=j))
    want = sorted(map(tuple, run().collect()), key=str)
    name = f"test-{uuid.uuid4().hex}"
    for number in (0, 3, 5):  # also in the steps that write the tables anew
        with pytest.raises(Stopped):
            run(Journal(spark, name, stop_at(number, phase)))
    j = Journal(spark, name)
    assert len(j.steps) == (5 if phase == EXPANDING else 6)
    assert sorted(map(tuple, run(j).collect()), key=str) == want
    phases = [(r.step, r.phase) for r in j.progress().orderBy("entry").collect()]
    done = [s for s, p in phases if p == READY]
    assert done == list(range(len(done))) == [s for s, p in phases if p == COMMITTING]
    again = Journal(spark, name)  # a finished run has nothing left to do
    steps = len(again.steps)
    assert sorted(map(tuple, run(again).collect()), key=str) == want and len(again.steps) == steps
    j.drop()
    assert not j.files.exists(j.path) and Journal(spark, name).steps == []


def test_a_step_that_was_renamed_already_is_finished(spark):
    name = f"test-{uuid.uuid4().hex}"
    j = Journal(spark, name, stop_at(0, COMMITTING))
    with pytest.raises(Stopped):
        j.commit({"x": spark.range(5)}, {"x": "id"})
    j.files.rename(f"{j.path}/step-000000.tmp", f"{j.path}/step-000000")
    j = Journal(spark, name)
    assert j.steps[0].tables["x"].counts == {"rows": 5} and j.read(j.steps[0], "x").count() == 5
    j.drop()


def test_a_rolled_back_step_leaves_nothing(spark):
    name = f"test-{uuid.uuid4().hex}"
    j = Journal(spark, name)
    bad = spark.range(4).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        j.commit({"good": spark.range(3), "bad": bad})
    j = Journal(spark, name)
    assert j.steps == [] and j.files.names(j.path) == ["progress"]
    assert j.commit({"good": spark.range(3)}, empty=True).tables["good"].counts == {"rows": 3}
    assert j.commit({"none": spark.range(0)}).tables["none"].counts == {"rows": 0}
    j.drop()


def exchanges_over(lines, at):
    """The Exchanges between a scan and the join above it."""
    indent = lambda x: len(x) - len(x.lstrip(" :+-|"))
    depth, found = indent(lines[at]), []
    for x in lines[at - 1 :: -1]:
        if indent(x) < depth:
            depth = indent(x)
            if "Join" in x:
                return found
            if "Exchange" in x:
                found.append(x)
    return found


@pytest.mark.parametrize("what", ["reach", "attractor"])
def test_no_pass_moves_what_is_stored_in_buckets(spark, tables, monkeypatch, what):
    nodes, edges = tables
    plans, commit = [], Journal.commit

    def planned(self, given, *args, **notes):
        plans.append([df._jdf.queryExecution().executedPlan().toString().splitlines() for df in given.values()])
        return commit(self, given, *args, **notes)

    monkeypatch.setattr(Journal, "commit", planned)
    monkeypatch.setattr(fixpoint, "BESIDE", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fixpoint.reach(edges, spark.range(1)) if what == "reach" else fixpoint.attractor(nodes, edges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    passes = [x[0] for x in plans[1:] if len(x) == 1 and any("Join" in y for y in x[0])]
    assert len(passes) > 5
    for lines in passes:
        stored = [k for k, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x]
        assert len(stored) >= 2 and not any(exchanges_over(lines, k) for k in stored)


def test_buckets_hold_the_rows(spark, tables):
    _, edges = tables
    assert sorted(map(tuple, in_buckets(edges, "src").collect())) == sorted(map(tuple, edges.collect()))
    assert in_buckets(edges.limit(0), "src").count() == 0
