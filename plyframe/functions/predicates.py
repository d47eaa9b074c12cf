"""Predicates of boards that need a loop on one state. They run as Arrow batches, on distinct
arguments where those repeat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def least_hitting_set(lines: list[int]) -> int:
    """Size of the smallest set of points that meets every line."""
    best = len(lines)

    def go(left: list[int], used: int) -> None:
        nonlocal best
        if used >= best:
            return
        if not left:
            best = used
            return
        m = left[0]
        while m:
            b = m & -m
            m ^= b
            go([x for x in left if not x & b], used + 1)

    go(lines, 0)
    return best


def mill_events(df: DataFrame, mask: str, mills: list[int], name: str = "events") -> DataFrame:
    """df with the least number of closings that can have made the full mills of a mask:
    computed once for each set of full mills, then joined back."""
    full = None
    for i, m in enumerate(mills):
        one = F.when(F.col(mask).bitwiseAND(F.lit(m).cast("long")) == m, F.lit(1 << i)).otherwise(0).cast("long")
        full = one if full is None else full.bitwiseOR(one)
    df = df.withColumn("_full", full)

    @F.pandas_udf("int")
    def solve(sets: pd.Series) -> pd.Series:
        return pd.Series([least_hitting_set([m for i, m in enumerate(mills) if s >> i & 1]) for s in sets])

    return df.join(df.select("_full").distinct().withColumn(name, solve("_full")), "_full").drop("_full")


def _near(w: int, h: int) -> list[list[int]]:
    return [[(y + dy) * w + x + dx for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + dx < w and 0 <= y + dy < h] for y in range(h) for x in range(w)]


def regions(mask: int, near: list[list[int]]) -> list[int]:
    """Connected parts of a mask."""
    out = []
    while mask:
        part, todo = mask & -mask, [(mask & -mask).bit_length() - 1]
        while todo:
            for v in near[todo.pop()]:
                if mask >> v & 1 and not part >> v & 1:
                    part |= 1 << v
                    todo.append(v)
        out.append(part)
        mask &= ~part
    return out


def _border(part: int, near: list[list[int]]) -> int:
    out = 0
    for c, vs in enumerate(near):
        if part >> c & 1:
            for v in vs:
                out |= 1 << v
    return out & ~part


def unconditionally_alive(own: int, opp: int, w: int, h: int) -> int:
    """Stones that cannot be taken even if their side always passes: chains with two regions
    of other cells, each of whose empty cells touches the chain, all of them enclosed by
    chains of that kind."""
    near = _near(w, h)
    board = (1 << w * h) - 1
    chains, areas = regions(own, near), regions(board & ~own, near)
    while True:
        kept = []
        for chain in chains:
            touch = _border(chain, near)
            vital = [a for a in areas if not (a & ~opp) & ~touch]
            if len(vital) >= 2:
                kept.append(chain)
        alive = sum(kept)
        inside = [a for a in areas if not _border(a, near) & own & ~alive]
        if (kept, inside) == (chains, areas):
            return alive
        chains, areas = kept, inside


def area_score(black: int, white: int, w: int, h: int) -> int:
    """Stones and empty regions that touch one colour only, black less white."""
    near = _near(w, h)
    score = black.bit_count() - white.bit_count()
    for part in regions(((1 << w * h) - 1) & ~(black | white), near):
        edge = _border(part, near)
        if bool(edge & black) != bool(edge & white):
            score += part.bit_count() if edge & black else -part.bit_count()
    return score


def board_columns(a: str, b: str, w: int, h: int) -> dict[str, Column]:
    """alive_a, alive_b and score of two masks of a board."""

    @F.pandas_udf("alive_a long, alive_b long, score int")
    def judge(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(unconditionally_alive(int(p), int(q), w, h), unconditionally_alive(int(q), int(p), w, h), area_score(int(p), int(q), w, h)) for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["alive_a", "alive_b", "score"])

    out = judge(F.col(a), F.col(b))
    return {n: out[n] for n in ("alive_a", "alive_b", "score")}


def territory_bounds(own: int, opp: int, burned: int, w: int, h: int) -> tuple[int, int]:
    """Moves each side can surely still make in parts of an amazons board that hold queens
    of one side only: a greedy walk that burns what it leaves, a lower bound."""
    eight = [[(y + dy) * w + x + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx or dy) and 0 <= x + dx < w and 0 <= y + dy < h] for y in range(h) for x in range(w)]
    out = [0, 0]
    for part in regions(((1 << w * h) - 1) & ~burned, eight):
        mine, theirs = part & own, part & opp
        if bool(mine) == bool(theirs):
            continue
        free = part & ~(own | opp)
        queens = mine or theirs
        while queens:
            at = (queens & -queens).bit_length() - 1
            queens &= queens - 1
            while step := [v for v in eight[at] if free >> v & 1]:
                at = min(step)
                free &= ~(1 << at)
                out[0 if mine else 1] += 1
    return out[0], out[1]


def corner_state(a: str, b: str, start: int, goal: int) -> Column:
    """illegal, lost or open for race games with home corners: a full goal corner with an own
    piece in it means the mover has already won, which no legal play reaches, so that test
    comes first; then the opponent's home in the mover's start corner, a loss."""
    occ = F.col(a).bitwiseOR(F.col(b))
    full = lambda m: occ.bitwiseAND(F.lit(m).cast("long")) == m
    inside = lambda c, m: F.col(c).bitwiseAND(F.lit(m).cast("long")) != 0
    return F.when(full(goal) & inside(a, goal), "illegal").when(full(start) & inside(b, start), "lost").otherwise("open")
