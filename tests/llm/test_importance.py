"""Importance resampling against a plain version of the whole query."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plyframe.llm import importance as im

CLASH = ["uid", "enough", "buckets", "n_features", "weight", "score", "rank", "bucket", "k"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, longest=1):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % im.N_BUCKETS for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=10, least=20, longest=1):
    s = Counter(b for _, t in docs for b in features(t, longest))
    t = Counter(b for x in target for b in features(x, longest))
    all_s, all_t, n = sum(s.values()), sum(t.values()), im.N_BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n))))
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text, longest)
        w = sum(map(gain, f))
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    first = able[: len(able) * percent // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(first)] + [(*r[:4], None) for r in [*able[len(first) :], *(r for r in rows if not r[4])]])


def prose(r, n):
    return r.choice([" ", ", ", "\n", "--"]).join("".join(r.choice("abcdEFé9") for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed, n=220):
    r = random.Random(seed)
    docs = [(i * 7 % 1000 - 30, r.choice([None, "", "...", prose(r, 5), prose(r, 19), prose(r, 20), prose(r, 60), "w" * 3000 + " x " * 30])) for i in range(n)]
    docs += [(2000 + i, prose(r, 25)) for i in range(60)] + [(500_000, prose(r, 30_000))]
    return docs, [prose(r, 15) for _ in range(10)] + [None]


def run(spark, docs, target, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    return Counter(map(tuple, im.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **options).collect()))


def test_checksums():
    r = random.Random(1)
    parts = [b"", *(r.randbytes(r.randint(0, 200)) for _ in range(50)), b"x" * im.TOGETHER, b"x" * (im.TOGETHER + 1)]
    end = np.cumsum([len(p) for p in parts])
    got = im.crc32(np.frombuffer(b"".join(parts), dtype=np.uint8), end - [len(p) for p in parts], end)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_tournament_merges_any_number_of_runs():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((r.randint(0, 9), r.random()) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(im.tournament(map(iter, runs))) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("draws, fan", [(1 << 16, 128), (3, 2)])
def test_draw_against_brute_force(spark, monkeypatch, draws, fan):
    """Also with many ranges, and more runs than a tree takes."""
    monkeypatch.setattr(im, "DRAWS", draws)
    monkeypatch.setattr(im, "FAN", fan)
    docs, target = corpus(3)
    assert run(spark, docs, target) == plain(docs, target)


def test_longer_runs_of_words_and_other_shares(spark):
    docs, target = corpus(5, 80)
    assert run(spark, docs, target, longest=3, percent=37, least_words=6) == plain(docs, target, 37, 6, 3)
    assert run(spark, docs, target, percent=100, least_words=0) == plain(docs, target, 100, 0)
    assert run(spark, docs, target, percent=0) == plain(docs, target, 0)


def test_edges(spark):
    assert run(spark, [], ["a b"]) == Counter()
    docs = [(i % 3, "a b c " * 10) for i in range(30)] + [(None, "a b c " * 10)] * 12  # repeated rows and ids, ties
    assert run(spark, docs, ["a"], percent=50) == plain(docs, ["a"], 50)
    assert run(spark, docs, []) == plain(docs, [])
