"""Fingerprints by the edit embedding, against a walk written out plainly."""

import hashlib
import random

import numpy as np
import pytest

from plyframe.llm import editprints as ep

CLASH = ["n_chars", "fingerprint", "part", "tail", "after", "following", "q", "d", "place", "view"]


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghiklmnoprstuwyé") for _ in range(r.randint(1, 8))) for _ in range(n))


def plain_print(text):
    """One step at a time; every step of the walk is written down, then the kept ones taken."""
    level = 0
    while 2 * len(text) > ep.SAMPLES << level:
        level += 1
    data = ep.classes([text])[0]
    i, step, walk = 0, 0, []
    while data[i]:
        walk.append(data[i])
        i += int(ep.coins(step // ep.STEPS)[step % ep.STEPS][data[i]])
        step += 1
    at = ep.kept(np.arange(len(walk) // 2**level + 2), level)
    return level, bytes(walk[p] for p in at if p < len(walk))


def test_prints_against_a_plain_walk(monkeypatch):
    r = random.Random(4)
    texts = ["", "a", "aa", "\0x", "\U0001f600é", "z" * 5000, *(prose(r, n) for n in (3, 20, 60, 200, 900, 2500))]
    want = [plain_print(t) for t in texts]
    assert ep.fingerprints(texts) == want
    monkeypatch.setattr(ep, "ALONE", -1)
    assert ep.fingerprints(texts) == want
    assert ep.fingerprints([]) == []


def test_kept_steps_are_nested():
    for level in range(1, 9):
        steps = ep.kept(np.arange(50), level)
        assert (steps >> level == np.arange(50)).all()
        assert set(steps) <= set(ep.kept(np.arange(200), level - 1))
        assert (ep.kept(ep.kept(np.arange(50), level, level - 1), level - 1) == steps).all()


def test_likeness_follows_edits():
    r = random.Random(7)
    few, many, other = [], [], []
    for _ in range(25):
        t = prose(r, 300)
        for out, edits in ((few, 2), (many, 120)):
            s = list(t)
            for _ in range(edits):
                s[r.randrange(len(s))] = r.choice("abc ")
            out.append(ep.likeness(*ep.fingerprints([t, "".join(s)])))
        other.append(ep.likeness(*ep.fingerprints([t, prose(r, 300)])))
    assert np.median(few) > 0.95 > np.median(many) > 0.25 > max(other)
    one = ep.fingerprints([prose(r, 40), ""])
    assert ep.likeness(one[0], one[0]) == ep.likeness(one[1], one[1]) == 1.0
    assert ep.likeness(*one) == ep.likeness(*one[::-1]) == 0.0
    assert ep.parsed(ep.shown(one[0])) == one[0]


def plain_rows(docs):
    docs = sorted(docs, key=lambda d: -d[0])
    for k, (i, t) in enumerate(docs):
        t, f = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + f[:half]
        a, b, c = (plain_print(x) for x in (t, changed, f))
        yield i, len(t), hashlib.sha256(changed.encode()).hexdigest(), ep.shown(a), ep.shown(b), ep.likeness(a, b), ep.likeness(a, c)


@pytest.mark.parametrize("together", [100, 12 << 20])
def test_rows_against_brute_force(spark, monkeypatch, together):
    monkeypatch.setattr(ep, "TOGETHER", together)
    r = random.Random(5)
    docs = [(3 * i - 20, r.choice([None, "", "x", prose(r, 3), prose(r, 30), prose(r, 400), "same text"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    got = ep.next_to_each_other(df)
    assert got.columns == ep._COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(plain_rows(docs))


def test_row_edges(spark):
    rows = lambda d: sorted(map(tuple, ep.next_to_each_other(spark.createDataFrame(d, "doc_id long, text string")).collect()), key=str)
    assert rows([]) == []
    assert rows([(5, "abcd")]) == list(plain_rows([(5, "abcd")]))
    twice = rows([(1, "abc"), (1, "abc"), (None, "zz"), (None, None)])
    assert len(twice) == 4 and sum(x[0] is None for x in twice) == 2
    assert [x[6] for x in twice if x[0] == 1].count(1.0) >= 1
    assert len({x[3] for x in twice if x[0] == 1}) == 1


def test_search_against_all_pairs(spark):
    r = random.Random(9)
    texts = [prose(r, r.choice([2, 30, 150, 400])) for _ in range(20)] + ["", None]
    for t in texts[:20]:
        for edits in (0, 1, 3, 8):
            s = list(t)
            for _ in range(edits):
                s[r.randrange(len(s))] = r.choice("abc ")
            texts.append("".join(s[: len(s) - r.choice([0, 0, len(s) // 8])]))
    prints = ep.fingerprinted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    by = {x.doc_id: ep.parsed(x.fingerprint) for x in prints.collect()}
    asked = [i for i in by if i % 3 == 0]
    want = {(a, b) for a in asked for b in by if ep.likeness(by[a], by[b]) >= ep.LEAST}
    got = [(x.query_id, x.doc_id) for x in ep.search(prints.where("doc_id % 3 = 0"), prints).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 2 * len(asked)
    with pytest.raises(ValueError):
        ep.search(prints, prints, 0.7)
    assert ep.search(prints.limit(0), prints).count() == 0
