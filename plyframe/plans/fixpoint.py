"""Iterative plans: reachability, layered sweeps, attractors. The driver holds a loop and a
count per pass. A pass of ``reach`` and ``attractor`` is one step of a journal: one Catalyst plan
over tables in the shared folder, written and counted by one job, whose output follows the
frontier. Under a name, a run that was broken off goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyframe.persist import cut, dealt, stored
from plyframe.plans.journal import Journal, Step, in_buckets

#: passes whose changes are kept beside the table that they change before they go into it
BESIDE = 8
#: rows of a side of a pass's join that Spark may broadcast, through the driver, at most
FEW_ROWS = 131_072


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _side(df: DataFrame, rows: int) -> DataFrame:
    """df of so many rows as a side of a join: a large one is joined by a merge, so that no
    pass sends it through the driver, however small its file is."""
    return df if rows <= FEW_ROWS else df.hint("merge")


def valued(edges: DataFrame, values: DataFrame, rows: int, known: int) -> DataFrame:
    """So many edges (src, dst) with the values of their children, of which so many (id, value)
    are known: few go to every task, many are merged in partitions as many as the rows need."""
    v = values.select(F.col("id").alias("dst"), "value")
    if known <= FEW_ROWS:
        return edges.join(F.broadcast(v), "dst")
    most = max(rows, known)
    return dealt(edges, most, "dst").join(dealt(v, most, "dst").hint("merge"), "dst")


def _rows(steps: list[Step], table: str) -> int:
    return sum(s.tables[table].counts["rows"] for s in steps if table in s.tables)


def _after(journal: Journal, table: str) -> tuple[Step | None, list[Step]]:
    """The last step that wrote ``table`` anew, and the steps since."""
    at = max((i for i, s in enumerate(journal.steps) if table in s.tables), default=None)
    return (None, []) if at is None else (journal.steps[at], journal.steps[at + 1 :])


def reach(edges: DataFrame, roots: DataFrame, most: int | None = None, journal: Journal | None = None) -> DataFrame:
    """(id, depth): what the roots reach, with the least number of steps. Each pass joins
    the frontier only and takes out what was seen. The states seen are kept in buckets of id;
    the frontiers of the last few passes are beside them. A journal that holds passes of the
    same run is taken up after the last."""
    j = journal or Journal(edges.sparkSession)
    if not j.steps:
        j.commit({"seen": roots.select("id").distinct().select("id", F.lit(0).alias("depth"))}, {"seen": "id"}, depth=0)
    e = None
    while True:
        base, beside = _after(j, "seen")
        last = j.steps[-1]
        name = "front" if "front" in last.tables else "seen"
        depth, grew = last.notes["depth"], last.tables[name].counts["rows"]
        if "front" in last.tables and not grew or not base.tables["seen"].counts["rows"] or depth == most:
            break
        seen, fronts = j.read(base, "seen"), [j.read(s, "front") for s in beside]
        if len(beside) >= BESIDE:
            j.commit({"seen": _all([seen, *fronts])}, {"seen": "id"}, depth=depth)
            j.forget(j.steps[-1].number)
            continue
        if e is None:
            e = in_buckets(edges.select(F.col("src").alias("id"), "dst"), "id")
        front = _side(fronts[-1] if fronts else seen.where(F.col("depth") == depth), grew)
        new = front.join(e, "id").select(F.col("dst").alias("id")).distinct().join(_side(seen, base.tables["seen"].counts["rows"]), "id", "left_anti")
        if fronts:
            new = new.join(_side(_all(fronts), _rows(beside, "front")), "id", "left_anti")
        j.commit({"front": new.select("id", F.lit(depth + 1).alias("depth"))}, depth=depth + 1)
    base, beside = _after(j, "seen")
    return _all([j.read(base, "seen"), *(j.read(s, "front") for s in beside)])


def layers(root: DataFrame, expand: Callable[[DataFrame], DataFrame], key: list[str], most: int = 1000) -> list[DataFrame]:
    """States by number of moves where every move leaves its layer for the next: each layer
    is deduplicated by itself. expand gives the key columns of the children. More than
    ``most`` layers are an error: the moves then lead back."""
    out = [cut(root.select(*key).distinct())]
    while True:
        new = cut(expand(out[-1]).select(*key).distinct())
        if new.isEmpty():
            return out
        if len(out) > most:
            raise ValueError(f"more than {most} layers")
        out.append(new)


def sweep(edges: DataFrame, leaves: DataFrame, fold: Column, deepest: int) -> DataFrame:
    """(layer, id, value) of a layered acyclic graph: edges (layer, src, dst) lead from a
    layer to the next, leaves (id, value) make up layer ``deepest``. One join and one
    aggregation a layer, no fixpoint; states without children have no row."""
    now = leaves.select(F.lit(deepest).alias("layer"), "id", "value")
    out = now
    for k in range(deepest - 1, -1, -1):
        below = now.select(F.col("id").alias("dst"), "value")
        now = edges.where(F.col("layer") == k).join(below, "dst").groupBy(F.col("src").alias("id")).agg(fold.cast("int").alias("value")).select(F.lit(k).alias("layer"), "id", "value")
        now = cut(now)
        out = out.unionByName(now)
    return out


def banded_sweep(states: DataFrame, edges: DataFrame, fold: Column, stuck: int) -> DataFrame:
    """(band, id, value) of states (band, id, value), value null where open, whose moves (src,
    dst) lead to bands with a larger number, not always the next: a band may stand for two
    measures, of which one rises and one falls. A band is one join with all later values;
    open states without moves get ``stuck``. Moves of open states are written once, in folders
    by band; a move that is there twice counts twice in the fold. Rows are dealt out by their
    number."""
    sizes = {r.band: r.n for r in states.groupBy("band").agg(F.count("*").alias("n")).collect()}  # one row a band
    rows, total = edges.count(), sum(sizes.values())
    most = max(rows, total)
    asked = dealt(states.where("value is null").select(F.col("id").alias("src"), "band"), most, "src").distinct().hint("merge")
    moves = stored(dealt(edges.select("src", "dst"), most, "src").join(asked, "src").select("src", "dst", "band"), "band")
    leaving = {r.band: r.n for r in moves.groupBy("band").agg(F.count("*").alias("n")).collect()}
    done: DataFrame | None = None
    known = 0
    for k in sorted(sizes, reverse=True):
        own, n = states.where(F.col("band") == k), leaving.get(k, 0)
        if done is not None and n:
            least = max(n, sizes[k])
            up = valued(moves.where(F.col("band") == k).select("src", "dst"), done, n, known)
            up = dealt(up.select(F.col("src").alias("id"), "value"), least, "id").groupBy("id").agg(fold.cast("int").alias("v"))
            own = dealt(own, least, "id").join(up.hint("merge"), "id", "left").withColumn("value", F.coalesce("value", "v"))
        own = cut(own.select("band", "id", F.coalesce("value", F.lit(stuck)).cast("int").alias("value")))
        done, known = own if done is None else done.unionByName(own), known + sizes[k]
    return done


#: parts that an attractor keeps count of at most
PARTS = 256


def attractor(nodes: DataFrame, edges: DataFrame, most: int | None = None, journal: Journal | None = None, part: Column | None = None) -> DataFrame:
    """(id, value, decided_at): win, loss and distance of every node of a cyclic graph.

    nodes are (id, value), value null where open; edges (src, dst) are distinct. In a pass
    an open node with a child lost in the pass before is won, and one whose children are
    all won is lost, so decided_at is the distance to the end under best play. What stays
    open has value null: a draw. For every open node the number of children not yet known to
    be won is kept; a pass joins the last decisions with their parents, and writes the open
    nodes that they touch. Every few passes the open nodes are written anew, in buckets of id,
    with the edges that lead from them, so later passes read neither decided nodes nor their
    edges; what was decided is written once and stays. most ends after so many passes. A node
    without children that is not decided stays open. A journal that holds passes of the same
    run is taken up.

    part, a whole number made of ``id`` with at most ``PARTS`` values, puts the open nodes in
    folders. How many are open in each is counted along with the passes, and a part without
    any is not read again.
    """
    j = journal or Journal(edges.sparkSession)
    folders = {"open": ["part"]} if part is not None else None
    parted = (lambda df: df.withColumn("part", part.cast("int"))) if part is not None else (lambda df: df)

    def sizes(df: DataFrame) -> dict:
        """How many nodes are open in each part: a row a part."""
        if part is None:
            return {}
        rows = df.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n")).limit(PARTS + 1).collect()
        if len(rows) > PARTS:
            raise ValueError(f"more than {PARTS} parts")
        return {"parts": {str(r.part): r.n for r in rows}}

    arrows = edges.select("src", F.col("dst").alias("id"))
    if not j.steps:
        nodes = nodes.select("id", F.col("value").cast("int"))
        degree = arrows.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("left"))
        open_ = nodes.where("value is null").select("id").join(degree, "id", "left").select("id", F.coalesce("left", F.lit(0)).cast("long").alias("left"))
        done = nodes.where("value is not null").select("id", "value", F.lit(0).alias("decided_at"))
        j.commit({"done": done, "open": parted(open_)}, {"open": "id"}, {"news": F.count(F.lit(1))}, folders, depth=0, **sizes(open_))
    e = None
    while True:
        base, beside = _after(j, "open")
        last = j.steps[-1]
        depth, news = last.notes["depth"], last.tables["moved" if "moved" in last.tables else "done"].counts["news"]
        if not news or depth == most:
            break
        # (id, left, won, value, decided_at): open nodes that a pass touched, with the children
        # that it found won, decided or still open
        moved = [j.read(s, "moved") for s in beside]
        open_, done = j.read(base, "open").drop("part"), j.read(base, "done")
        left_in = {k: n - sum(s.tables["moved"].counts.get(f"part {k}", 0) for s in beside) for k, n in base.notes.get("parts", {}).items()}
        if part is not None and len(beside) < BESIDE:
            open_ = j.read(base, "open").where(F.col("part").isin([int(k) for k, n in left_in.items() if n])).drop("part")
        if len(beside) >= BESIDE:
            rest, decided = _settled(open_, moved)
            now = F.count_if(F.col("decided_at") == depth)
            told = {"parts": {k: n for k, n in left_in.items() if n}} if part is not None else {}
            stay = base.tables["open"].counts["rows"]
            live = (arrows if e is None else e).join(_side(rest.select(F.col("id").alias("src")), stay), "src", "left_semi")
            j.commit({"done": decided, "open": parted(rest), "edges": live.select("src", "id")}, {"open": "id", "edges": "id"}, {"news": now}, folders, depth=depth, **told)
            j.forget(j.steps[-1].number, ("done",))
            e = None
            continue
        if e is None:
            e = j.read(base, "edges") if "edges" in base.tables else in_buckets(arrows, "id")
        front = _side(moved[-1].where("value is not null") if moved else done.where(F.col("decided_at") == depth), news)
        touched = e.join(front.select("id", "value"), "id").groupBy(F.col("src").alias("id")).agg(F.bool_or(F.col("value") == -1).alias("lost"), F.count_if(F.col("value") == 1).alias("won"))
        touched = touched.join(_side(open_, base.tables["open"].counts["rows"]), "id")
        before = F.lit(0)
        if moved:
            earlier = _all(moved).groupBy("id").agg(F.sum("won").alias("before"), F.max("decided_at").alias("at"))
            touched = touched.join(_side(earlier, _rows(beside, "moved")), "id", "left").where("at is null")
            before = F.coalesce("before", F.lit(0))
        value = F.when(F.col("lost"), 1).when(F.col("won") + before >= F.col("left"), -1)
        step = touched.select("id", "won", value.alias("value")).where("won > 0 or value is not null")
        step = step.select("id", "won", F.col("value").cast("int").alias("value"), F.when(F.col("value").isNotNull(), F.lit(depth + 1)).alias("decided_at"))
        news = {"news": F.count_if(F.col("value").isNotNull())}
        for k, n in left_in.items():
            if n:
                news[f"part {k}"] = F.count_if((part.cast("int") == int(k)) & F.col("value").isNotNull())
        j.commit({"moved": step}, None, news, depth=depth + 1)
    base, beside = _after(j, "open")
    rest, decided = _settled(j.read(base, "open").drop("part"), [j.read(s, "moved") for s in beside])
    undecided = rest.select("id", F.lit(None).cast("int").alias("value"), F.lit(None).cast("int").alias("decided_at"))
    return _all([*(j.read(s, "done") for s in j.steps if "done" in s.tables), *([decided] if decided is not None else []), undecided])


def _settled(open_: DataFrame, moved: list[DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """What is open after the passes, (id, left), and what they decided."""
    if not moved:
        return open_, None
    changes = _all(moved)
    sums = changes.groupBy("id").agg(F.sum("won").alias("won"), F.max("decided_at").alias("at"))
    rest = open_.join(sums, "id", "left").where("at is null").select("id", (F.col("left") - F.coalesce("won", F.lit(0))).alias("left"))
    return rest, changes.where("value is not null").select("id", "value", "decided_at")


def layered_attractor(nodes: DataFrame, edges: DataFrame, order: list[int]) -> DataFrame:
    """(layer, id, value, decided_at) where a layer's edges stay in it or lead to layers
    solved before: nodes are (layer, id, value), edges (src, dst), ids are unique over all
    layers. A child outside enters as a constant: a lost one wins at once, a drawn one
    keeps its parent from being lost. What a layer leaves open is a draw."""
    solved: DataFrame | None = None
    for k in order:
        own = nodes.where(F.col("layer") == k).select("id", "value")
        mine = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi")
        around = own
        if solved is not None:
            # decided children of other layers, drawn ones open and without children
            outside = mine.select(F.col("dst").alias("id")).distinct().join(own, "id", "left_anti")
            known = outside.join(solved.select("id", "value"), "id").select("id", F.when(F.col("value") != 0, F.col("value")).alias("value"))
            around = own.unionByName(known)
        got = attractor(around, mine).join(own.select("id"), "id", "left_semi")
        got = cut(got.select(F.lit(k).alias("layer"), "id", F.coalesce("value", F.lit(0)).alias("value"), "decided_at"))
        solved = got if solved is None else solved.unionByName(got)
    return solved


def audit(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, value, expected): decided states whose value is not what their children give;
    no row in a right table. States without children are not judged. Null is a draw."""
    v = values.select("id", F.coalesce("value", F.lit(0)).alias("value"))
    c = edges.join(v.select(F.col("id").alias("dst"), F.col("value").alias("child")), "dst").groupBy(F.col("src").alias("id")).agg(F.max(-F.col("child")).alias("expected"))
    return v.join(c, "id").where("value <> expected")


def depth_audit(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, decided_at, expected): wins that are not one past their quickest loss, losses
    not one past their slowest win."""
    child = values.select(F.col("id").alias("dst"), F.col("value").alias("cv"), F.col("decided_at").alias("cd"))
    c = edges.join(child, "dst").groupBy(F.col("src").alias("id")).agg(F.min(F.when(F.col("cv") == -1, F.col("cd"))).alias("quick"), F.max(F.when(F.col("cv") == 1, F.col("cd"))).alias("slow"))
    want = F.when(F.col("value") == 1, F.col("quick") + 1).when(F.col("value") == -1, F.col("slow") + 1)
    return values.where("value is not null").join(c, "id").withColumn("expected", want).where("decided_at <> expected").select("id", "decided_at", "expected")


def best_line(edges: DataFrame, values: DataFrame, root: int, most: int = 1000) -> list[int]:
    """The ids of a best line from root: the quickest won way, the slowest lost one, ties
    to the smallest id. One small query a move. A line of more than ``most`` moves is an
    error."""
    v = values.select(F.col("id").alias("dst"), "value", "decided_at")
    known = values.where(F.col("id") == root).select("value").first()
    line, at = [root], root
    while known is not None and known.value in (1, -1):
        child = edges.where(F.col("src") == at).join(v, "dst").where(F.col("value") == -known.value)
        at_next = child.orderBy((F.col("decided_at") if known.value == 1 else -F.col("decided_at")), "dst").select("dst", "value").first()
        if at_next is None:
            break
        at, known = at_next.dst, at_next
        line.append(at)
        if len(line) > most + 1:
            raise ValueError(f"a line of more than {most} moves")
    return line


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): every pair of a node and one that it reaches by a step or more. Each pass
    joins the pairs found last with themselves and with all before, so paths double; it ends
    when nothing is new. The pairs are the result, and may be as many as nodes squared."""
    found = new = cut(edges.select("src", "dst").distinct())
    while not new.isEmpty():
        step = lambda a, b: a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        new = cut(step(new, found).unionByName(step(found, new)).distinct().join(found, ["src", "dst"], "left_anti"))
        found = cut(found.unionByName(new))
    return found


def probe_moves(states: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id, move, value, decided_at): for the asked states every child, the value seen by
    the side that moves there; undecided children are draws."""
    child = values.select(F.col("id").alias("dst"), (-F.coalesce("value", F.lit(0))).alias("value"), "decided_at")
    return states.select(F.col("id").alias("src")).join(edges, "src").join(child, "dst").select(F.col("src").alias("id"), F.col("dst").alias("move"), "value", "decided_at")
