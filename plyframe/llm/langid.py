"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of the text, lower-cased (A-Z) and with every run of other bytes
than letters (a-z or 0x80 and above) as one blank. Two gated recurrent networks read it from
either end, across words, and every position gets a distribution over the languages. A
document's label has the largest sum of log probabilities over all positions of the whole
text, its score is the mean probability of that label.

Texts are read in windows of ``CORE`` bytes and ``AROUND`` bytes before and after, whose
positions are labelled with the windows that they belong to. So many windows are read at a
time, and a very long text takes no more memory than its bytes.

Training is numpy back-propagation through time on the driver, on a bounded sample of
labelled rows (``PER_LANGUAGE`` documents and ``PIECES`` pieces a language).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import LOWER, table

CORE, AROUND = 112, 16
#: windows that are read together
TOGETHER = 1024
HIDDEN = 12
#: bounds of the training sample, and bytes of a piece
PER_LANGUAGE = 150
PIECES = 4000
PIECE = 64
STEPS, BATCH, RATE = 260, 96, 0.012
#: a document whose best language has a lower score is rejected by the pipeline's stage
LEAST_SCORE = 0.4
_BLANK, _END = 0x20, 0x0A
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else _BLANK for b in LOWER)


def stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the network reads of all texts, and how many each has."""
    data = np.frombuffer(b"\n".join(t.encode("utf-8", "surrogatepass").translate(_LETTERS) for t in texts), dtype=np.uint8)
    letter = data > _BLANK
    first = np.empty(len(data), dtype=bool)
    first[:1] = False
    np.logical_and(data[1:] == _BLANK, letter[:-1], out=first[1:])
    read = letter | first
    ends = np.flatnonzero(data == _END)
    upto = np.cumsum(read)[np.append(ends, len(data)) - 1] if len(data) else np.zeros(len(texts), dtype=np.int64)
    if len(data) and len(ends) and ends[0] == 0:
        upto[0] = 0
    return data[read], np.diff(upto, prepend=0)


class Batch:
    """Pieces in order of falling length, as rows of byte values; step t of the network
    works on the first ``live[t]`` rows, so nothing is padded."""

    def __init__(self, words: list[bytes]):
        size = np.array([len(w) for w in words])
        self._lay(np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate(([0], np.cumsum(size)[:-1])), size)

    @classmethod
    def cut(cls, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> Batch:
        """Pieces of an array of bytes, by start and size."""
        out = cls.__new__(cls)
        out._lay(flat, start, size)
        return out

    def _lay(self, flat, start, size):
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        steps = int(self.size[0])
        start = start[self.order]
        self.live = np.searchsorted(-self.size, -np.arange(steps), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.live)))
        row = np.concatenate([np.arange(n) for n in self.live])
        step = np.repeat(np.arange(steps), self.live)
        self.row, self.step = row, step
        self.forward = flat[start[row] + step]
        back = self.size[row] - 1 - step
        self.backward = flat[start[row] + back]
        #: where the backward pass has the position that the forward pass has at each place
        self.mirror = self.offset[back] + row


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Direction:
    """One gated recurrent network; byte inputs select rows of ``w``."""

    def __init__(self, rng):
        self.w = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32)

    def run(self, data: np.ndarray, b: Batch, keep: bool = False):
        k = HIDDEN
        out = np.empty((len(data), k), dtype=np.float32)
        h = np.zeros((b.live[0], k), dtype=np.float32)
        saved = []
        for t, n in enumerate(b.live):
            lo = b.offset[t]
            h = h[:n]
            g = self.w[data[lo : lo + n]]
            hu = h @ self.u
            zr = _sigmoid(g[:, : 2 * k] + hu[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(g[:, 2 * k :] + r * hu[:, 2 * k :])
            new = c + z * (h - c)
            if keep:
                saved.append((z, r, c, h, hu[:, 2 * k :]))
            out[lo : lo + n] = h = new
        return out, saved

    def read(self, data: np.ndarray, b: Batch, v: np.ndarray) -> np.ndarray:
        """What run gives, times v; without keeping the states, and so that a sigmoid costs a
        hyperbolic tangent and a step no array but those of its gates."""
        k = HIDDEN
        wz, wr, wc = (np.ascontiguousarray(self.w[:, i * k : (i + 1) * k] * f, dtype=np.float32) for i, f in enumerate((0.5, 0.5, 1)))
        uz, ur, uc = (np.ascontiguousarray(self.u[:, i * k : (i + 1) * k] * 0.5, dtype=np.float32) for i in range(3))
        out = np.empty((len(data), v.shape[1]), dtype=np.float32)
        h = np.zeros((b.live[0], k), dtype=np.float32)
        for t, n in enumerate(b.live):
            at = slice(b.offset[t], b.offset[t] + n)
            d, h = data[at], h[:n]
            z, r, c = h @ uz, h @ ur, h @ uc
            z += wz.take(d, axis=0)
            r += wr.take(d, axis=0)
            np.tanh(z, out=z)
            np.tanh(r, out=r)
            r += 1
            c *= r
            c += wc.take(d, axis=0)
            np.tanh(c, out=c)
            h = h - c
            z += 1
            z *= 0.5
            h *= z
            h += c
            np.matmul(h, v, out=out[at])
        return out

    def back(self, data, b: Batch, saved, dout):
        k = HIDDEN
        dw, du = np.zeros_like(self.w), np.zeros_like(self.u)
        later = np.zeros((0, k), dtype=np.float32)
        for t in range(len(b.live) - 1, -1, -1):
            n, lo = b.live[t], b.offset[t]
            z, r, c, h, hc = saved[t]
            d = dout[lo : lo + n].copy()
            d[: len(later)] += later
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            np.add.at(dw, data[lo : lo + n], np.concatenate([dz, dr, dc], axis=1))
            dhu = np.concatenate([dz, dr, dc * r], axis=1)
            du += h.T @ dhu
            later = d * z + dhu @ self.u.T
        return dw, du


class Tagger:
    """Labels every position of a piece with a distribution over ``langs``."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.f, self.b = Direction(rng), Direction(rng)
        self.v = rng.normal(0, 0.3, (2 * HIDDEN, len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), dtype=np.float32)

    def _logits(self, x: Batch, keep=False):
        hf, sf = self.f.run(x.forward, x, keep)
        hb, sb = self.b.run(x.backward, x, keep)
        h = np.concatenate([hf, hb[x.mirror]], axis=1)
        s = h @ self.v + self.c
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True)), h, sf, sb

    def positions(self, words: list[bytes]) -> list[np.ndarray]:
        """For each piece a (bytes, languages) array of probabilities."""
        x = Batch(words)
        logp = self._logits(x)[0]
        out: list = [None] * len(words)
        for r, i in enumerate(x.order):
            out[i] = np.exp(logp[x.offset[: x.size[r]] + r])
        return out

    def totals(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of texts that follow each other in flat, by their sizes: sums of log probabilities
        and sums of probabilities over all positions."""
        k = len(self.langs)
        out = np.zeros((len(size), 2 * k))
        begin = np.cumsum(size) - size
        parts = -(-size // CORE)
        text = np.repeat(np.arange(len(size)), parts)
        core = begin[text] + CORE * (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts))
        lo, hi = np.maximum(core - AROUND, begin[text]), np.minimum(core + CORE + AROUND, (begin + size)[text])
        vf, vb = (np.ascontiguousarray(x, dtype=np.float32) for x in (self.v[:HIDDEN], self.v[HIDDEN:]))
        for a in range(0, len(text), TOGETHER):
            now = slice(a, a + TOGETHER)
            x = Batch.cut(flat, lo[now], (hi - lo)[now])
            s = self.f.read(x.forward, x, vf)
            s += self.b.read(x.backward, x, vb)[x.mirror]
            s += self.c
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            total = p.sum(axis=1, keepdims=True)
            both = np.concatenate([s - np.log(total), p / total], axis=1)
            skip = (core - lo)[now][x.order][x.row]
            both[(x.step < skip) | (x.step >= skip + CORE)] = 0
            sums = np.zeros((len(x.size), 2 * k))
            for t, n in enumerate(x.live):
                sums[:n] += both[x.offset[t] : x.offset[t] + n]
            np.add.at(out, text[now][x.order], sums)
        return out

    def fit(self, words: list[bytes], label: np.ndarray, seed: int = 11) -> None:
        """Adam on the mean cross entropy of all positions."""
        rng = np.random.default_rng(seed)
        params = [self.f.w, self.f.u, self.b.w, self.b.u, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(words), min(BATCH, len(words)))
            x = Batch([words[i] for i in pick])
            y = label[pick][x.order][x.row]
            logp, h, sf, sb = self._logits(x, keep=True)
            d = np.exp(logp)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            dh = d @ self.v.T
            dhb = np.zeros((len(y), HIDDEN), dtype=np.float32)
            dhb[x.mirror] = dh[:, HIDDEN:]
            grads = [*self.f.back(x.forward, x, sf, dh[:, :HIDDEN]), *self.b.back(x.backward, x, sb, dhb), h.T @ d, d.sum(axis=0)]
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for p, g, a, q in zip(params, grads, m, s):
                a += 0.1 * (g - a)
                q += 0.01 * (g * g - q)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)


def train(labelled: DataFrame) -> Tagger:
    """A tagger from (doc_id, text, lang) rows with lang not null. Every language gives
    about ``PER_LANGUAGE`` documents, chosen by a hash of the id; all their text counts."""
    rows = labelled.where("lang is not null and text is not null")
    counts = sorted(tuple(r) for r in rows.groupBy("lang").count().collect())  # one row a language
    if not counts:
        return Tagger([])
    share = F.lit(0)
    for lang, n in counts:
        share = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, PER_LANGUAGE / n)))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = rows.where(place < share).select("doc_id", "lang", "text").orderBy(place, "doc_id", "text").limit(2 * PER_LANGUAGE * len(counts)).collect()
    langs = [x for x, _ in counts]
    rng = np.random.default_rng(3)
    words, label = [], []
    for i, lang in enumerate(langs):
        flat, size = stream([r.text for r in sorted((r for r in sample if r.lang == lang), key=lambda r: (r.doc_id, r.text))])
        begin = np.cumsum(size) - size
        full = np.flatnonzero(size)
        for j in rng.choice(full, PIECES) if len(full) else ():
            at = begin[j] + rng.integers(0, max(1, size[j] - PIECE + 1))
            words.append(flat[at : min(at + PIECE, begin[j] + size[j])].tobytes())
            label.append(i)
    model = Tagger(langs)
    if words and len(langs) > 1:
        model.fit(words, np.array(label))
    return model


def read(model: Tagger, texts: list[str | None]) -> list[tuple[str, float]]:
    """The label and the score of each text."""
    known = [i for i, t in enumerate(texts) if model.langs and t and any(map(str.isalpha, t))]
    out = [("und", 0.0)] * len(texts)
    if not known:
        return out
    flat, size = stream([texts[i] for i in known])
    k = len(model.langs)
    for i, n, s in zip(known, size.tolist(), model.totals(flat, size)):
        best = int(np.argmax(s[:k]))
        out[i] = (model.langs[best], float(min(1.0, s[k + best] / n)))
    return out


def identify(docs: DataFrame, model: Tagger) -> DataFrame:
    """All columns of docs, then lang_pred and score; a scan without a shuffle.

    A null or empty text or one without a letter is ``und`` with score 0, as is every text
    where nothing was learned. Of languages with equal sums the first by name is taken.
    Repeated rows are labelled alike. A very long text is read in windows; its bytes are held
    once. An empty table gives an empty table. Columns named lang_pred or score are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            out, part, size = [], [], 0
            for t in texts:
                part.append(t)
                size += len(t or "")
                if size > 1 << 21:
                    out += read(model, part)
                    part, size = [], 0
            out += read(model, part)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.drop("lang_pred", "score").withColumn("__ply_l", label("text")).select("*", "__ply_l.lang_pred", "__ply_l.score").drop("__ply_l")


#: the fold that is never learned from
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"


def learn(docs: DataFrame) -> Tagger:
    """From the rows outside the held-out fold; a row without an id is not used."""
    return train(docs.where(f"doc_id is not null and not {HELD_OUT}").select("doc_id", "text", "lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows whose language is undetermined or scored below ``least``; null
    and empty texts are undetermined. Repeated rows stay or go together, and so for the rest
    as in identify. Columns unchanged."""
    return identify(docs, learn(docs)).where(f"lang_pred <> 'und' and score >= {least}").select(docs.columns)
