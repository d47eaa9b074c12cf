"""Hard negatives against plain inner products over all pairs."""

import math
import random

import numpy as np
import pytest

from plyframe.llm import negatives as ng


def plain(rows, anchor, positives=5, negatives=5):
    """rows: {id: (label, integer vector)}"""
    out = []
    for a in filter(anchor, rows):
        la, va = rows[a]
        s = {b: sum(x * y for x, y in zip(va, v)) for b, (_, v) in rows.items() if b != a and len(v) == len(va)}
        order = sorted(s, key=lambda b: (-s[b], b))
        for p in [b for b in order if rows[b][0] == la][:positives]:
            fit = [b for b in order if rows[b][0] != la and 80 * s[p] <= 100 * s[b] <= 100 * s[p]][:negatives]
            out += [(a, p, k + 1, b, s[p], s[b]) for k, b in enumerate(fit)]
    return sorted(out)


def clean(given):
    rows = {}
    for i, label, v in given:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**62:
            rows[i] = min(rows.get(i, (label, q)), (label, q))
    return rows


def run(spark, given, condition, **options):
    df = spark.createDataFrame(given, "id long, label long, v array<double>").repartition(5)
    return sorted(map(tuple, ng.hard_negatives(ng.integer_rows(df), condition, **options).collect()))


def vectors(seed, n, dim, labels, near=0.6):
    r = np.random.default_rng(seed)
    middle = r.normal(size=dim)
    x = near * middle + (1 - near) * r.normal(size=(n, dim)) * np.linspace(2, 0.2, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(r.integers(labels)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("anchors, rows", [(16_384, 4096), (7, 50)])
def test_against_all_pairs(spark, monkeypatch, anchors, rows):
    """Also with many tiles."""
    monkeypatch.setattr(ng, "ANCHORS", anchors)
    monkeypatch.setattr(ng, "ROWS", rows)
    given = vectors(1, 400, 24, 3)
    want = plain(clean(given), lambda i: i % 20 == 0)
    assert run(spark, given, "id % 20 = 0") == want and len(want) > 300


def test_ties_edges_and_odd_rows(spark):
    r = random.Random(3)
    inf, nan = math.inf, math.nan
    given = [(i, r.randrange(3), r.choice([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.5], [0.3, 0.3]])) for i in range(80)]  # many equal
    given += [(None, 1, [1.0, 0.0]), (200, None, [1.0, 0.0]), (210, 1, None), (220, 1, [1.0, None]), (230, 1, [inf, 0.0]), (240, 1, [nan, 0.0])]
    given += [(250, 1, []), (251, 1, []), (252, 2, []), (260, 1, [1.0] * 5), (261, 1, [0.9] * 5), (262, 2, [0.95] * 5), (270, 1, [1e300, 1.0]), (280, 1, [4e6, 4e6]), (281, 1, [4e6, 4e6]), (282, 2, [4e6, 3.9e6])]
    given += [(0, 2, [9.0, 9.0]), (10, 0, [1.0, 0.0]), (10, 0, [1.0, 0.0])]  # ids that repeat
    assert run(spark, given, "id % 10 = 0") == plain(clean(given), lambda i: i % 10 == 0)
    assert run(spark, given, "id % 10 = 0", positives=2, negatives=1) == plain(clean(given), lambda i: i % 10 == 0, 2, 1)
    assert run(spark, [], "id = 0") == []
    assert run(spark, [(0, 1, [1.0])], "id = 0") == []


def test_bounds_never_discard_a_wanted_pair():
    """Random blocks and windows, the rotation a wrong one for these vectors too."""
    r = np.random.default_rng(8)
    for dim in (1, 3, 16, 64):
        x = r.integers(-300, 300, size=(90, dim))
        x[:, 0] *= 5
        other = np.linalg.qr(r.normal(size=(dim, dim)))[0]
        for turn in (None, other, np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]):
            a, b = (ng.Block([v.astype("<i4").tobytes() for v in part], dim, turn) for part in (x[:20], x[20:]))
            score = x[:20] @ x[20:].T
            high = np.sort(r.choice(score.ravel(), size=(20, 3)), axis=1)
            low = high - abs(high) // 3
            allowed = r.random(score.shape) < 0.8
            ids = r.permutation(1000)[:70]
            i, w, j, s, exact = ng.search(a, b, allowed, low, high, ids, 4, ng.slack_of(turn, dim))
            got = sorted(zip(i.tolist(), w.tolist(), ids[j].tolist(), s.tolist()))
            want = []
            for q in range(20):
                for k in range(3):
                    fit = [c for c in range(70) if allowed[q, c] and low[q, k] <= score[q, c] <= high[q, k]]
                    want += [(q, k, int(ids[c]), int(score[q, c])) for c in sorted(fit, key=lambda c: (-score[q, c], ids[c]))[:4]]
            assert got == sorted(want) and exact <= allowed.sum()


def test_most_pairs_are_discarded_early():
    given = clean(vectors(2, 3000, 64, 1))
    packed = [np.array(v, dtype="<i4").tobytes() for _, v in given.values()]
    x = np.array([v for _, v in given.values()], dtype=np.float64)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    a, b = ng.Block(packed[:50], 64, turn), ng.Block(packed, 64, turn)
    ids = np.arange(3000)
    *_, exact = ng.search(a, b, ids[:50, None] != ids[None, :], np.full((50, 1), -ng._ANY), np.full((50, 1), ng._ANY), ids, 5, ng.slack_of(turn, 64))
    assert exact < 0.4 * 50 * 3000
