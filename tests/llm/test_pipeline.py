"""Mixing against its own normal equations, and the pipeline against plain stages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plyframe.llm import decontaminate, langid, linededup, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=150):
    r = random.Random(seed)
    say = lambda k, words: " ".join(r.choice(words) for _ in range(k))
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(900)]
    rude = ["zzgrr", "zzmug", "zzfool"]
    rows, labels = [], []
    for i in range(n):
        kind = "toxic" if i % 7 == 0 else "good"
        words = say(r.randint(20, 60), plain).split()
        if kind == "toxic":
            for w in rude:
                words.insert(r.randrange(len(words)), w)
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        rows.append((i, text, "en", "s", len(text)))
        if i % 2 == 0 or kind == "toxic":
            labels.append((i, 1, int(kind == "toxic")))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_and_targets(spark, tables):
    docs, labels = tables
    got = mixing.mix(docs.selectExpr("*", "1 as rate", "2 as marks", "3 as p"), labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.p_toxic > 0.5) == (r.doc_id % 7 == 0)
        assert abs(r.p_good + r.p_poor + r.p_toxic - 1) < 1e-6
        assert (r.rate == 0) == (r.doc_id % 7 == 0)
    total = sum(r.rate * r.p_toxic * r.n_tokens for r in got)
    assert total < 0.02 * sum(r.rate * r.n_tokens for r in got)


def test_rates_reach_attainable_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(5, 500)), (p := rng.dirichlet([0.4, 0.4, 0.4])).tolist()) for _ in range(200)]
    df = spark.createDataFrame(rows, "n_tokens long, p array<double>")
    want = {"a": 0.5, "b": 0.3, "c": 0.2}
    rates, info = mixing.fit_rates(df, ["a", "b", "c"], want)
    for d in want:
        assert abs(info["reached"][d] - info["goal"][d]) < 2e-3 * sum(info["goal"].values())
    assert info["miss"] < 1e-3
    found = {tuple(r.p): r.rate for r in rates.collect()}
    assert min(found.values()) >= 0
    # sums by hand
    totals = sum(np.array(p) * n * found[tuple(p)] for n, p in rows)
    assert np.allclose(totals, [info["reached"][d] for d in "abc"], rtol=1e-6)


def nonnegative_least_squares(a, b, rounds=3000):
    """Coordinate descent on |a x - b|^2 over x >= 0."""
    x = np.zeros(a.shape[1])
    left = b.astype(float).copy()
    size = (a * a).sum(axis=0)
    for _ in range(rounds):
        for j in range(len(x)):
            new = max(0.0, x[j] + a[:, j] @ left / size[j])
            left -= a[:, j] * (new - x[j])
            x[j] = new
    return x, left


@pytest.mark.parametrize("sharp", [0.2, 2.0])
def test_rates_against_an_independent_solver(spark, sharp):
    """The distance to targets that may be out of reach, in the metric of the descent."""
    rng = np.random.default_rng(5)
    n = rng.integers(5, 500, 40)
    p = rng.dirichlet([3 * sharp, sharp, sharp], 40)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    _, info = mixing.fit_rates(df, ["a", "b", "c"], {"a": 0.9, "b": 0.1, "c": 0.0})
    goal = np.array([info["goal"][d] for d in "abc"])
    m = (p * n[:, None]).T @ p
    root = np.linalg.cholesky(np.linalg.inv(m)).T
    _, left = nonnegative_least_squares(root @ (p * n[:, None]).T, root @ goal)
    off = root @ (np.array([info["reached"][d] for d in "abc"]) - goal)
    # in parts of the goal: no further from it than the solver, but for half a hundredth
    of_goal = np.linalg.norm(root @ goal)
    assert np.linalg.norm(off) <= 1.01 * np.linalg.norm(left) + 0.005 * of_goal
    assert (info["miss"] > 0.01) == (np.linalg.norm(left) > 0.01 * of_goal)


def test_posteriors_against_a_plain_naive_bayes(spark, tables):
    docs, labels = tables
    marks = {r.doc_id: (r.n_tokens, set(r.marks)) for r in mixing.features(docs, "doc_id").collect()}
    domain = {r.doc_id: "toxic" if r.toxic else "good" for r in labels.collect()}
    size = {d: sum(x == d for x in domain.values()) for d in ("good", "toxic")}
    every = sum(size.values())
    pseudo = (mixing.SMOOTH + mixing.SMOOTH_SHARE * every) / every
    rate = lambda m, d: (sum(m in marks[i][1] for i, x in domain.items() if x == d) + pseudo * size[d]) / size[d]
    telling = {m for m in set().union(*(marks[i][1] for i in domain)) if round(np.log(rate(m, "toxic") / rate(m, "good")), 3) >= mixing.TELLING}
    count = lambda i: min(mixing.MOST, len(telling & marks[i][1]))
    seen = {d: np.full(mixing.MOST + 1, 0.5) for d in size}
    for i, d in domain.items():
        seen[d][count(i)] += 1
    got = {r.doc_id: r for r in mixing.mix(docs, labels).collect()}
    for i in marks:
        odds = np.log(size["toxic"] / size["good"]) + np.log(seen["toxic"][count(i)] / seen["toxic"].sum()) - np.log(seen["good"][count(i)] / seen["good"].sum())
        assert abs(got[i].p_toxic - 1 / (1 + np.exp(-odds))) < 1e-6 and got[i].p_poor == 0


def test_signs_around_words_do_not_hide_them(spark):
    df = spark.createDataFrame([(1, 'One, "two"%%% THREE!! four'), (2, "one two three four")], "doc_id long, text string")
    a, b = (set(r.marks) for r in mixing.features(df, "doc_id").orderBy("doc_id").collect())
    assert len(b) == 5 and len(a & b) >= 4 and len(a - b) >= 2


def test_mixing_edges(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "x y", None, None, 3), (1, "again", "en", "s", 5), (1, "again", "en", "s", 5)], DOCS)
    strange = spark.createDataFrame([(None, 1, 0), (3, None, None), (2, 1, 0), (2, 0, 1), (99_999, 1, 0)], labels.schema)
    got = mixing.mix(docs.unionByName(odd), labels.unionByName(strange)).collect()
    assert len(got) == docs.count() + 5
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (5000, 5001))
    assert {r.rate for r in mixing.mix(docs, labels.limit(0)).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_native_plans_hold_no_python(spark, tables):
    docs, labels = tables
    for df in (mixing.mix(docs, labels), linededup.deduplicate(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows, labels = corpus(5, 120)
    r = random.Random(9)
    passage = " ".join("".join(r.choice("klmnopq") for _ in range(5)) for _ in range(60))
    item = " ".join("".join(r.choice("rstuvw") for _ in range(4)) for _ in range(20))
    rows += [(1000, rows[3][1], "en", "s", 1), (1001, f"{rows[8][1]} {item}", "en", "s", 1), (1002, "12 34", "en", "s", 5), (1003, None, None, None, None)]
    rows = [(i, f"{t}\n{passage}" if i in (10, 20, 30) else t, *rest) for i, t, *rest in rows]
    sf = f"{tmp_path}/sf"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "mix"]
    outs = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "mix":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append({x.doc_id: x.text for x in docs.collect()})
    lang, lines, near, clean, mixed = outs
    assert set(lang) == {i for i, *_ in rows} - {1002, 1003}
    assert 1000 not in lines and lines[10].endswith(passage) and passage not in lines[20] + lines[30]
    fps = {i: simhash.fingerprint(t) for i, t in lines.items()}
    for i in lines:  # every document that went has a smaller near copy, no other has one that stayed
        close = [j for j in lines if j != i and (fps[i] ^ fps[j]).bit_count() <= 3]
        assert i in near or any(j < i for j in close)
        assert i not in near or not any(j in near for j in close)
    assert set(near) - set(clean) == {1001}
    assert {i for i in clean if i % 7 == 0 and i < 1000} & set(mixed) == set()
    assert {i for i in clean if i % 7 and i < 1000} <= set(mixed)
    assert {x.doc_id for x in corpus_pipeline.run(spark, sf).collect()} == set(mixed)


def test_stages_on_an_empty_table(spark, tmp_path):
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_modules_are_those_named():
    assert all(m.__name__.startswith("plyframe.llm") for m in (decontaminate, langid, linededup, mixing, simhash))
