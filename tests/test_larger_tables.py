"""Queries on tables with keys and groups that the small ones do not have."""

import decimal

from pyspark.sql import functions as F

from plyframe import io_queries, persist, queries
from plyframe.operators import tables
from plyframe.plans import fixpoint, journal, partwise, refinement, sampling
from plyframe.sources.derived import supply_edges, supply_leaves


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_bits_of_a_number_past_the_cells_shown(spark, tmp_path):
    big = (1 << 40) + (1 << 20) + 5
    save(spark, tmp_path, "part", [(big,), (7,), (0,)], "p_partkey long")
    got = {r.p_partkey: (r.n, list(r.cells), r.again) for r in queries.bits_explode(spark, str(tmp_path)).collect()}
    assert got == {big: (4, [0, 2], big), 7: (3, [0, 1, 2], 7), 0: (0, [], 0)}


def test_remainders_in_one_aggregation(spark, tmp_path, monkeypatch):
    """No table is written line by line; a line of unknown quantity is taken or left too."""

    def refused(df):
        raise AssertionError("written")

    monkeypatch.setattr(queries, "cut", refused)
    lines = [(1, q) for q in (3.0, 4.0, 10.0, 7.0)] + [(2, None)] + [(3, float(i)) for i in range(1, 31)]
    save(spark, tmp_path, "lineitem", [(k, 1, i, q) for i, (k, q) in enumerate(lines)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    want = {}
    for order in (1, 2, 3):
        ways = {0: 1}
        for q in (int(q or 0) for k, q in lines if k == order):
            more = dict(ways)
            for r, n in ways.items():
                more[(r + q) % 7] = more.get((r + q) % 7, 0) + n
            ways = more
        want |= {(order, r): decimal.Decimal(n) for r, n in ways.items()}
    assert {(r.l_orderkey, r.residue): r.ways for r in queries.count_dp(spark, str(tmp_path)).collect()} == want


def test_many_rows_are_many_buckets(spark, monkeypatch):
    """What walks, walls and colours join in place."""
    monkeypatch.setattr(journal, "TASK_ROWS", 10)
    df = journal.in_buckets(spark.range(95), "id", 95)
    assert df.count() == 95 and len(df.inputFiles()) == 10
    given, real = [], journal.in_buckets
    for module in (refinement, sampling, tables):
        monkeypatch.setattr(module, "in_buckets", lambda df, key, rows: given.append((key, rows)) or real(df, key, rows))
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src long, dst long")
    assert refinement.refine(edges).count() == 3
    sampling.walks(edges, spark.createDataFrame([(1, 1)], "walk long, id long"), 2)
    items = spark.createDataFrame([(1, 1), (1, 2)], "g long, id long")
    assert tables.independent_sets_within(items, items.selectExpr("g", "id as a", "id + 1 as b").where("a = 1"), "g", 2).count() == 3
    assert given == [("other", 6), ("id", 3), ("g", 2)]


def test_passes_broadcast_no_large_side(spark, monkeypatch):
    """Seen, open and new states of a pass go past the driver, however small their files are."""
    monkeypatch.setattr(fixpoint, "FEW_ROWS", 0)
    plans, commit = [], journal.Journal.commit

    def planned(self, given, *args, **notes):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for k, df in given.items() if k in ("front", "moved"))
        return commit(self, given, *args, **notes)

    monkeypatch.setattr(journal.Journal, "commit", planned)
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    fixpoint.reach(edges, spark.range(1))
    fixpoint.attractor(spark.createDataFrame([(i, -1 if i == 4 else None) for i in range(5)], "id long, value int"), edges)
    assert len(plans) > 6 and not any("Broadcast" in x for x in plans)


def test_edges_of_decided_nodes_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "BESIDE", 2)
    kept, commit = [], journal.Journal.commit

    def counted(self, given, *args, **notes):
        step = commit(self, given, *args, **notes)
        if "edges" in given:
            kept.append((step.tables["edges"].counts["rows"], step.tables["done"].counts["rows"]))
        return step

    monkeypatch.setattr(journal.Journal, "commit", counted)
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10), (10, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(i, -1 if i == 7 else None) for i in (*range(8), 9, 10)], "id long, value int")
    got = {r.id: (r.value, r.decided_at) for r in fixpoint.attractor(nodes, edges).collect()}
    assert got == {i: (-1 if (7 - i) % 2 == 0 else 1, 7 - i) for i in range(8)} | {9: (None, None), 10: (None, None)}
    assert kept[:3] == [(7, 2), (5, 2), (3, 2)]


def save_supply(spark, folder, lines):
    """Nations 0 and 1, the second lost; supplier s is of nation s % 2; order i is of part i % 20 and supplier i % 6."""
    save(spark, folder, "nation", [(0, 2), (1, 0)], "n_nationkey int, n_regionkey int")
    save(spark, folder, "supplier", [(s, s % 2) for s in range(6)], "s_suppkey long, s_nationkey int")
    save(spark, folder, "lineitem", [(i, i % 20, i % 6) for i in range(lines)], "l_orderkey long, l_partkey long, l_suppkey long")
    save(spark, folder, "part", [(i,) for i in range(20)], "p_partkey long")
    save(spark, folder, "orders", [(i,) for i in range(lines + 1)], "o_orderkey long")


def test_a_sweep_in_parts_deals_rows_out_by_their_number(spark, tmp_path, monkeypatch):
    """More rows are more tasks, in every step; large sides are merged."""
    monkeypatch.setattr(fixpoint, "FEW_ROWS", 0)
    tasks, plans, commit = {}, [], journal.Journal.commit

    def watched(self, given, *args, **notes):
        for k, df in given.items():
            tasks.setdefault((k, notes.get("layer")), []).append(df.rdd.getNumPartitions())
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return commit(self, given, *args, **notes)

    monkeypatch.setattr(persist, "DEALT_ROWS", 5, raising=False)
    monkeypatch.setattr(journal.Journal, "commit", watched)
    save_supply(spark, tmp_path, 60)
    got = partwise.sweep_in_parts(supply_edges(spark, str(tmp_path)), supply_leaves(spark, str(tmp_path)), 3, 2).collect()
    supplier = {s: -1 if s % 2 == 0 else 1 for s in range(6)}
    part = {p: max(-supplier[i % 6] for i in range(60) if i % 20 == p) for p in range(20)}
    want = {(3, 0, 1), (3, 1, -1)} | {(2, s, v) for s, v in supplier.items()} | {(1, p, v) for p, v in part.items()} | {(0, i, -part[i % 20]) for i in range(60)}
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert tasks["edges", None][0] >= 24 and tasks["values", 0] == [12]
    assert len(tasks["partial", 0]) == 2 and max(tasks["partial", 0]) >= 6
    assert not any("Broadcast" in x for x in plans)


def test_a_banded_sweep_deals_rows_out_by_their_number(spark, tmp_path, monkeypatch):
    """More rows are more tasks in every band; large sides are merged; an order without lines is lost."""
    monkeypatch.setattr(fixpoint, "FEW_ROWS", 0)
    tasks, plans, cut = [], [], fixpoint.cut

    def watched(df):
        tasks.append(df.rdd.getNumPartitions())
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(persist, "DEALT_ROWS", 5, raising=False)
    monkeypatch.setattr(fixpoint, "cut", watched)
    save_supply(spark, tmp_path, 60)
    got = io_queries.banded_sweep(spark, str(tmp_path)).collect()
    supplier = {s: -1 if s % 2 == 0 else 1 for s in range(6)}
    part = {p: max(-supplier[i % 6] for i in range(60) if i % 20 == p) for p in range(20)}
    want = {(3, 0, 1), (3, 1, -1)} | {(2, s, v) for s, v in supplier.items()} | {(1, p, v) for p, v in part.items()}
    want |= {(0, i, max(-part[i % 20], -supplier[i % 6])) for i in range(60)} | {(0, 60, -1)}
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert tasks[-2:] == [12, 24]  # 60 moves of parts, 120 of orders
    assert not any("Broadcast" in x for x in plans)


def test_moves_of_a_band_are_read_alone_and_counted_as_given(spark):
    """Decided states keep their value, and moves within a band or back count for nothing."""
    states = spark.createDataFrame([(0, 1, None), (0, 2, None), (1, 3, None), (2, 4, -1), (2, 5, 1), (1, 6, 0)], "band int, id long, value int")
    moves = spark.createDataFrame([(1, 4), (1, 4), (1, 3), (2, 1), (3, 5), (3, 2), (6, 4)], "src long, dst long")
    got = {x.id: (x.band, x.value) for x in fixpoint.banded_sweep(states, moves, F.count("value"), -1).collect()}
    assert got == {1: (0, 3), 2: (0, -1), 3: (1, 1), 4: (2, -1), 5: (2, 1), 6: (1, 0)}
    assert fixpoint.banded_sweep(states, moves.limit(0), F.count("value"), -1).where("value = -1").count() == 4
