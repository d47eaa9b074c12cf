"""Mixing to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier over counts of telling words, learned from a bounded sample of the
labelled table, gives every document posterior probabilities over the domains. Document rates r >= 0 are
then fitted so that the expected tokens of each domain, T = sum r n p, match targets t:
projected gradient descent on 1/2 (T - t)' M^-1 (T - t) with M = sum n p p'. In the metric
of the token counts the gradient of a document is p' M^-1 (T - t) and the Lipschitz
constant is one, so each step is r <- max(0, r - p' g) with a vector g as long as there
are domains; steps start a little beyond the last point, which makes them quicker. All rates start at one, so documents with equal posteriors have equal rates, and
the passes go over the distinct posteriors with their tokens. The driver holds only vectors.

The descent ends where the targets are met or where a step no longer changes the totals: then
they are as near as rates can bring them, and the report says by how much they are missed.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import cut, few, stored, table

#: labelled documents of each domain that the classifier counts, about
PER_DOMAIN = 6000
#: pseudo-counts of a word, a number and a share of the sample, dealt out by the domains'
#: sizes: an unseen word says nothing, and one seen a few times too little to be telling
SMOOTH, SMOOTH_SHARE = 6.0, 0.0013
#: a word tells a domain if it raises its log odds by this. Others mostly show the language:
#: hundreds of them agree, and a product of their odds would drown the telling ones
TELLING = 2.2
#: a document's telling words of a domain are counted up to this; the counts are what the
#: classifier takes as independent given the domain
MOST = 3
#: the most telling words kept: the size of the model
WORDS = 4000
#: steps at most, and how many of them are one expression before the rates are written
STEPS, WRITTEN = 200, 10
#: a miss, and a change of the totals by a step, in parts of all tokens, that end the descent
CLOSE, STILL = 1e-4, 1e-6
#: domains of the labelled table and their target weights
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'good' when quality = 0 then 'poor' end"
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}
#: taken off both ends of a word; what loses some of these is also counted as it was
SIGNS = "!\"#$%&'()*+-/<=>?@[]^_`{|}~0123456789"


def features(docs: DataFrame, *more: str) -> DataFrame:
    """(more, n_tokens, marks) of every row: words are the parts between blanks, line feeds
    and stops; marks are the hashes of a text's distinct words, in lower case and without
    signs around them, of those that had signs as they were, and one for the share of
    distinct words, in tenths. No shuffle."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[ \n.,;:]"), lambda x: x != "")
    rows = docs.select(*more, F.explode(F.array(words)).alias("w"))
    rows = rows.select(*more, "w", F.explode(F.array(F.transform("w", lambda x: F.btrim(x, F.lit(SIGNS))))).alias("b"))
    kinds = F.array_distinct(F.transform("b", lambda x: F.xxhash64(x)))
    signed = F.array_distinct(F.transform(F.filter("w", lambda x, i: x != F.get("b", i)), lambda x: F.xxhash64(x)))
    rows = rows.select(*more, F.size("w").cast("long").alias("n_tokens"), F.explode(F.array(F.struct(kinds.alias("k"), signed.alias("s")))).alias("m"))
    tenth = F.floor(10 * F.size("m.k") / F.greatest("n_tokens", F.lit(1)))
    return rows.select(*more, "n_tokens", F.concat("m.k", "m.s", F.array(F.xxhash64(F.lit("share of distinct words"), tenth))).alias("marks"))


def _count(keys: list[int]) -> str:
    """How many of a text's marks are among the keys, ``MOST`` at most."""
    if not keys:
        return "0"
    listed = ", ".join(f"{k}L" if k > -(1 << 63) else "bigint(-9223372036854775808)" for k in keys)
    return f"least({MOST}, size(filter(marks, h -> h in ({listed}))))"


def classify(docs: DataFrame, labelled: DataFrame, domains: list[str], *more: str) -> DataFrame:
    """(more, n_tokens, p) of every row of docs: p are the posterior probabilities in the order
    of domains. labelled has (doc_id, domain); a document labelled twice counts under the
    smaller name. About ``PER_DOMAIN`` labelled documents of each domain, chosen by a hash
    of the id, give the word counts; all labels give the priors. A domain without labelled
    rows gets probability 0; without any labels p is null. Texts are scanned, not shuffled:
    the sample's ids, at most twice ``PER_DOMAIN`` for each domain, are broadcast."""
    one = stored(labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain")))
    n = {r.domain: r["count"] for r in one.groupBy("domain").count().collect()}  # one row a domain
    rows = features(docs, *more)
    if not n:
        return rows.drop("marks").withColumn("p", F.lit(None).cast("array<double>"))
    share = F.lit(0)
    for d, k in sorted(n.items()):
        share = F.when(F.col("domain") == d, F.lit(int((1 << 30) * min(1.0, PER_DOMAIN / k)))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = one.where(place < share).orderBy(place, "doc_id").limit(2 * PER_DOMAIN * len(domains))
    seen = stored(features(docs.join(F.broadcast(sample), "doc_id"), "domain").select("domain", "marks"))
    used = {r.domain: r["count"] for r in seen.groupBy("domain").count().collect()}
    base = max(n, key=lambda d: (n[d], d))
    known = [d for d in domains if d in used]
    score = {d: F.lit(math.log(n[d] / n[base])) for d in n}
    told: dict[str, list[int]] = {}
    if base in used and len(known) > 1:
        every = sum(used.values())
        pseudo = (SMOOTH + SMOOTH_SHARE * every) / every
        rate = lambda d: (F.count_if(F.col("domain") == d) + F.lit(pseudo * used[d])) / F.lit(float(used[d]))
        rest = [d for d in known if d != base]
        odds = seen.select("domain", F.explode("marks").alias("m")).groupBy("m").agg(*[F.round(F.ln(rate(d) / rate(base)), 3).alias(f"in_{i}") for i, d in enumerate(rest)])
        strength = F.greatest(*[F.col(f"in_{i}") for i in range(len(rest))], F.lit(-1e9))
        model = odds.where(strength >= TELLING).orderBy(F.desc(strength), "m").limit(WORDS).collect()
        told = {d: [r.m for r in model if r[f"in_{i}"] >= TELLING] for i, d in enumerate(rest)}
        for e in rest:
            got = seen.select("domain", F.expr(_count(told[e])).alias("c")).groupBy("domain", "c").count().collect()  # MOST + 1 rows a domain
            share = {d: np.full(MOST + 1, 0.5) for d in known}
            for r in got:
                share[r.domain][r.c] += r["count"]
            share = {d: np.log(v / v.sum()) for d, v in share.items()}
            for d in known:
                ratio = ", ".join(f"{x:.6f}D" for x in share[d] - share[base])
                score[d] = score[d] + F.expr(f"element_at(array({ratio}), c_{rest.index(e)} + 1)")
        counts = [F.expr(_count(told[d])).alias(f"c_{i}") for i, d in enumerate(rest)]
    else:
        counts = []
    rows = rows.select(*more, "n_tokens", F.explode(F.array(F.struct(F.lit(0).alias("_"), *counts))).alias("c")).select(*more, "n_tokens", "c.*")
    scores = F.array(*[score.get(d, F.lit(None)).cast("double") for d in domains])
    out = rows.withColumn("_s", F.explode(F.array(scores)))
    top = F.array_max("_s")
    e = F.transform("_s", lambda x: F.coalesce(F.exp(x - top), F.lit(0.0)))
    out = out.withColumn("_e", F.explode(F.array(e)))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return out.select(*more, "n_tokens", F.transform("_e", lambda x: F.round(x / total, 9)).alias("p"))


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], tokens: float | None = None) -> tuple[DataFrame, dict]:
    """(p, rate) of the distinct posteriors, and a report. rows have n_tokens and p; those
    without p are left out. Targets are shares of ``tokens``, by default so many that the
    domain with the largest share keeps its own tokens. The report has the goal and the
    totals reached, the steps, and the miss in parts of all tokens."""
    k = range(len(domains))
    p = [F.get("p", F.lit(i)) for i in k]
    n = F.col("n").cast("double")
    state = cut(rows.where("p is not null").groupBy("p").agg(F.sum("n_tokens").alias("n"))).withColumn("rate", F.lit(1.0))
    first = state.agg(*[F.sum(n * p[i]).alias(f"t{i}") for i in k], *[F.sum(n * p[i] * p[j]).alias(f"m{i}_{j}") for i in k for j in k if i <= j]).first()
    now = np.array([first[f"t{i}"] or 0.0 for i in k])
    share = np.array([targets.get(d, 0.0) for d in domains])
    report = lambda goal, steps: {"reached": dict(zip(domains, now.tolist())), "goal": dict(zip(domains, goal.tolist())), "steps": steps, "miss": float(np.abs(now - goal).sum() / max(goal.sum(), 1e-300))}
    if not now.sum() or not share.sum():
        return state.select("p", "rate"), report(now, 0)
    share = share / share.sum()
    lead = int(np.argmax(share))
    goal = share * (tokens if tokens is not None else now[lead] / share[lead])
    m = np.zeros((len(domains), len(domains)))
    for i in k:
        for j in k:
            m[i, j] = first[f"m{min(i, j)}_{max(i, j)}"] or 0.0
    inverse = np.linalg.pinv(m, rcond=1e-9)
    # accelerated: a step starts beyond the last one, at a point whose totals are linear in
    # the two before, so it takes no pass of its own
    size = lambda x: float((x - goal) @ inverse @ (x - goal))
    state = state.withColumn("last", F.col("rate"))
    before, steps, moved, pace = now, 0, np.inf, 1.0
    while steps < STEPS and np.abs(now - goal).sum() > CLOSE * goal.sum() and moved > STILL * goal.sum():
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead = (pace - 1) / faster if size(now) <= size(before) else 0.0
        pace = faster if size(now) <= size(before) else 1.0
        g = inverse @ (now + ahead * (now - before) - goal)
        start = F.col("rate") + F.lit(ahead) * (F.col("rate") - F.col("last"))
        new = F.greatest(F.lit(0.0), start - sum((F.lit(float(g[i])) * p[i] for i in k), F.lit(0.0)))
        state = state.select("p", "n", new.alias("rate"), F.col("rate").alias("last"))
        steps += 1
        if steps % WRITTEN == 0:
            state = cut(state)
        got = state.agg(*[F.sum(n * p[i] * F.col("rate")).alias(f"t{i}") for i in k]).first()
        before, now = now, np.array([got[f"t{i}"] for i in k])
        moved = np.abs(now - before).sum()
    return cut(state.select("p", "rate")), report(goal, steps)


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *more: str) -> tuple[DataFrame, dict]:
    """(more, n_tokens, p, rate) of every row, and the report of the fit."""
    domains = sorted(targets)
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(DOMAIN).alias("domain")).where("doc_id is not null and domain is not null")
    judged = stored(classify(docs, labelled, domains, *more))
    rates, report = fit_rates(judged, domains, targets)
    if report["miss"] > 0.01:
        warnings.warn(f"no rates bring the domains nearer to their targets than {report}", stacklevel=3)
    found = few(rates.select(F.col("p").alias("_p"), F.round("rate", 6).alias("rate")), str(len(domains) + 1))
    rated = judged.join(found, F.col("p") == F.col("_p"), "left").drop("_p")
    return rated.withColumn("rate", F.coalesce("rate", F.lit(1.0))), report


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate) per row of docs.

    A null or blank text has no tokens and the prior's posteriors. Repeated rows have rates
    of their own, which are equal, as are those of all rows with equal posteriors. Without
    labels the posteriors are null and all rates one. Labels with null marks, or of unknown
    documents, are not used; of two labels of a document the domain that comes first by name
    counts. A very long text is one row whose distinct words are held at once. Extra columns
    are left out. An empty table gives an empty table.
    """
    domains = sorted(targets)
    rated, _ = _rated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, targets, "doc_id")
    return rated.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixture(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with n_tokens and their rate, without those whose rate is zero. Nulls, empty and
    long texts, ties, repeated rows and empty tables as in mix. Columns named n_tokens or rate
    are replaced, others kept, whatever their names."""
    names = [c for c in docs.columns if c not in ("n_tokens", "rate")]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*names).alias("__ply_row"))
    rated, _ = _rated(packed, labels, TARGETS, "__ply_row")
    return rated.where("rate > 0").select("__ply_row.*", "n_tokens", "rate")
