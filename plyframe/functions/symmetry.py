"""Symmetry reduction: canonical keys, orbits, and the groups themselves."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plyframe.functions.bits import col, permute


def grid_symmetries(w: int, h: int) -> list[list[int]]:
    """Cell permutations of a w x h board: 8 for a square, else 4; the identity first."""
    out = []
    for transpose in (False, True) if w == h else (False,):
        for fy in (False, True):
            for fx in (False, True):
                perm = []
                for c in range(w * h):
                    x, y = c % w, c // w
                    x, y = (w - 1 - x if fx else x), (h - 1 - y if fy else y)
                    if transpose:
                        x, y = y, x
                    perm.append(y * w + x)
                out.append(perm)
    return out


def automorphisms(n: int, edges: list[tuple[int, int]], lines: list[tuple[int, ...]] = ()) -> list[list[int]]:
    """All permutations of a small graph's points that keep its edges and lines, found by
    extending partial maps; meant for boards of up to a few dozen points."""
    near = [frozenset(b for a, b in edges if a == v) | frozenset(a for a, b in edges if b == v) for v in range(n)]
    kept = {frozenset(x) for x in lines}
    out: list[list[int]] = []

    def extend(m: list[int]) -> None:
        v = len(m)
        if v == n:
            if all(frozenset(m[p] for p in x) in kept for x in kept):
                out.append(m)
            return
        for t in range(n):
            if t not in m and len(near[t]) == len(near[v]) and all((u in near[v]) == (m[u] in near[t]) for u in range(v)):
                extend([*m, t])

    extend([])
    return out


def images(masks: list[str | Column], perms: list[list[int]]) -> list[Column]:
    """One struct of permuted masks for every symmetry."""
    return [F.struct(*[permute(m, p).alias(f"m{i}") for i, m in enumerate(masks)]) for p in perms]


def canonical(masks: list[str | Column], perms: list[list[int]]) -> Column:
    """The least image as a struct m0, m1, ...; equal for all states of an orbit."""
    every = images(masks, perms)
    return F.least(*every) if len(every) > 1 else every[0]


def is_representative(masks: list[str | Column], perms: list[list[int]]) -> Column:
    return F.struct(*[col(m).alias(f"m{i}") for i, m in enumerate(masks)]) == canonical(masks, perms)


def orbit_size(masks: list[str | Column], perms: list[list[int]]) -> Column:
    """The number of different images: the weight of a representative."""
    return F.size(F.array_distinct(F.array(*images(masks, perms))))


def fixed_by(masks: list[str | Column], perm: list[int]) -> Column:
    """Whether a symmetry leaves a state as it is; their count over all states and
    symmetries, divided by the group's order, is the number of orbits."""
    test = None
    for m in masks:
        same = permute(m, perm) == col(m)
        test = same if test is None else test & same
    return test


def brute_automorphisms(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """All automorphisms by trying every permutation: a check for n up to eight."""
    e = {frozenset(x) for x in edges}
    return [list(p) for p in permutations(range(n)) if {frozenset(p[v] for v in x) for x in e} == e]


def mirror_weight(block: str | Column, mirror: str | Column) -> Column:
    """Weight of a block of states under a mirror: 2 for the first of a pair, 1 for a block
    that is its own mirror, null for the one that is dropped."""
    a, b = col(block), col(mirror)
    return F.when(a < b, 2).when(a == b, 1)
