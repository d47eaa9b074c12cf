"""Personal data: four patterns, and a linear-chain conditional random field.

The base spans are the matches of four patterns. The random field labels tokens (runs of
letters, runs of digits, long strings of both, single other characters) from their shape, a short list of cue
words, and the shapes of their neighbours; it adds spans that the patterns miss, such as
numbers without their usual marks, spelled-out addresses, keys and titled names. It is
trained from the labelled table below by gradient ascent on its log likelihood, and
decoded by Viterbi, all lines of a batch at a time. A run of labelled tokens needs at
least one token whose own scores can outweigh the best possible transitions, so lines
without such a token are known to hold nothing and are not decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import table

#: order of kinds at equal starts
KINDS = ["email", "ip", "card", "phone", "id", "name", "secret"]
BASE = KINDS[:4]

# fixed values: the patterns of the base kinds
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Labelled table: text with spans written as {kind:text}.
LABELLED = """
Please write to {email:anna.berg@mail.example.org} before Friday.
You can reach {email:jo at mail dot example dot com} for the forms.
Send the file to {email:lee_k [at] post [dot] example [dot] net} today.
Her address is {email:mia (at) example (dot) org} and she answers fast.
The contact was {email:t.rossi at uni dot example dot edu} all along.
The server {ip:10.0.14.250} did not answer.
It listens on {ip:192.168.7.21} and {ip:172.16.0.9} since Monday.
Requests from {ip:203.0.113.77} were blocked.
The card {card:4111 1111 1111 1111} was declined.
He paid with {card:5500-0000-0000-0004} in March.
Charge my visa {card:4111111111111111} please.
Call me at {phone:+1 (202) 555-0143} after six.
My phone is {phone:555-210-4477} and I am home.
Phone: {phone:(202) 555-0188} or come by.
Tel. {phone:030 555 1299} is the desk.
Call {phone:202-555-0110} now.
A mobile number, {phone:+44 20 7946 0958}, was left.
My ssn is {id:219-09-9999} as you know.
SSN {id:078-05-1120} was on the form.
The iban {id:DE89 3704 0044 0532 0130 00} belongs to her.
IBAN: {id:GB29NWBK60161331926819} for the transfer.
passport {id:K1234567} expired last year.
My name is {name:Clara Hoffman} and I live here.
I met {name:Mr. Peter Lang} at the door.
Then {name:Dr. Elena Ruiz} signed it.
{name:Mrs. Okafor} wrote back at once.
token = "{secret:9f86d081884c7d659a2feaa0c55ad015}" was in the log.
api_key = {secret:a94a8fe5ccb19ba61c4c0873d391e987} in the file.
password: {secret:hunter2x9Q} was shared.
Her secret = "{secret:b5bb9d8014a0f9b1d61e21e796d78dcc}" leaked.
The meeting is at 10.30 on 12 May 2021 in room 204.
We sold 1,250 units for 99.95 each in 2019.
Version 2.4.1 of the tool came out on 2020-11-05.
See page 12 and chapter 7, section 3.2 for more.
He ran 100 metres in 10.8 seconds, then 200 in 21.
In 1984 there were 350 of them, and 4200 in 1999.
Table 3-4 lists 15 to 20 items at 30 percent.
The Old House stood by The River at Noon.
Anna and Peter went to Berlin with Maria in June.
Come and see us at the house, or at the lake.
At that time the key was on the table.
The dot on the map is where the phone box was.
Her name is known here, and the card was red.
A token of thanks, no secret at all.
Nothing here. Only words, and then more words.
The build of commit 3f1c9a7be04d52c6a8e19b7d0f4c2a6e58b1d973 went through.
Its sha256 is 60303ae22b998861bce3b28f33eec1be758a213c86c93c076dbe9f558c11c752 as listed.
Authorization: Bearer {secret:mF9xB5f41JqM7sPq2LrT8vWz} was sent.
The api key {secret:AKXT7Q2LMNB5RZW8D4VC} is in the old file.
secret: {secret:p4ssw0rdWith77Signs} should go.
The old password {secret:9d2c41f08be7a6353c1d0e8f7b2a6495} no longer works.
Use the key {secret:Zk81pQ0vR7mX2cT9bL4nW6yD} for now.
Le train part à 8 heures et arrive à 12.
Die Stadt hat 3 500 Häuser und 12 Brücken.
El tren sale a las 9 y llega a las 14.
*** END OF PART ONE ***
## Chapter 4: The Return ##
50% off!!! Buy now!!! Only today!!!
THE OLD MAN AND THE SEA, 1952, PAGE 40!
STOP!! DO NOT OPEN!! THIS IS THE LAST CALL!!
Name | Price | Stock | Shelf
Bolt | 0.35 | 1200 | B-14
if (a[i] != b && n > 0) { x += 2; } # done
See https://shop.example.org/a/b?id=42&page=7 for the list.
Very very very very very good, he said.
The The Band played on, and on, and on.
Par ici. Bon. On y va. Et puis?
Dann los. Ein Wort noch. Der Weg ist weit.
Es verdad. Un dia mas. La mesa esta lista.
Rain. Stone and Ash. Wind in May. Over.
He saw East End. Then Park Lane. The gate was shut.
Été. Où est la mer. Çela va.
At dawn they left. To the hills. Com is no word here.
To whom it may concern: To be or not to be.
""".strip().split("\n")

CUES = [
    "at", "dot", "call", "phone", "tel", "mobile", "number", "card", "visa", "ssn", "iban", "passport", "name", "is", "mr", "mrs", "ms", "dr",
    "token", "key", "secret", "password", "mail", "com", "org", "net", "edu", "to", "my", "the", "of", "and", "or",
]
PUNCT = "@.+-()[]_=:\"'/#,&%*"
SHAPES = ["pad", "lower", "lower1", "Upper", "UPPER", "long", "d1", "d2", "d3", "d4", "d5-8", "d9-11", "d12-19", "d20+", "other", *PUNCT, *(f"cue {c}" for c in CUES), "mixed16-31", "mixed32+"]
N_SHAPES = len(SHAPES)
_SPACE, _LETTER, _DIGIT, _OTHER, _BREAK = range(5)
CLASS = np.full(128, _OTHER, dtype=np.uint8)
CLASS[[9, 11, 12, 32]] = _SPACE
CLASS[[10, 13]] = _BREAK
CLASS[48:58] = _DIGIT
CLASS[65:91] = CLASS[97:123] = _LETTER
_PUNCT_SHAPE = np.full(128, SHAPES.index("other"), dtype=np.int16)
for _c in PUNCT:
    _PUNCT_SHAPE[ord(_c)] = SHAPES.index(_c, 15)
_DIGIT_SHAPE = np.array([6 + (0, 0, 1, 2, 3, 4, 4, 4, 4, 5, 5, 5, *[6] * 8)[n] if n < 20 else 13 for n in range(21)], dtype=np.int16)


#: length from which a string of letters and digits is one token
MIXED = 16


def _cue_key(size, first, second, third, last):
    return ((((size * 128 + first) * 128) + second) * 128 + third) * 128 + last


def _cue_table():
    pairs = []
    for i, c in enumerate(CUES):
        b = c.encode()
        pairs.append((_cue_key(len(b), b[0], b[1], b[min(2, len(b) - 1)], b[-1]), SHAPES.index(f"cue {c}")))
    pairs.sort()
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int16)


_CUE_KEYS, _CUE_SHAPES = _cue_table()


def tokens(points: np.ndarray):
    """Start, end, shape of every token of an array of code points, and the line each is on."""
    low = np.minimum(points, 127).astype(np.uint8)
    cls = CLASS[low]
    cls[points > 127] = _LETTER
    new = np.empty(len(cls), dtype=bool)
    new[:1] = True
    np.not_equal(cls[1:], cls[:-1], out=new[1:])
    new |= cls == _OTHER
    # long strings of letters and digits are one token, however often they change
    turn = np.flatnonzero(np.diff(np.concatenate(([0], ((cls == _LETTER) | (cls == _DIGIT)).view(np.int8), [0]))))
    parts = np.concatenate(([0], np.cumsum(new)))
    long = np.flatnonzero((turn[1::2] - turn[::2] >= MIXED) & (parts[turn[1::2]] - parts[turn[::2]] > 1))
    for i in long.tolist():
        new[turn[2 * i] + 1 : turn[2 * i + 1]] = False
    edge = np.flatnonzero(new)
    end = np.append(edge[1:], len(cls))
    kind = cls[edge]
    line = np.cumsum(kind == _BREAK)
    keep = (kind != _SPACE) & (kind != _BREAK)
    start, end, kind, line = edge[keep], end[keep], kind[keep], line[keep]
    size = end - start
    shape = np.full(len(start), 1, dtype=np.int16)
    first, second, last = low[start], low[np.minimum(start + 1, end - 1)], low[end - 1]
    big, big2 = (first >= 65) & (first <= 90), (second >= 65) & (second <= 90)
    shape[size == 1] = 2
    shape[big] = 3
    shape[big & big2 & (size > 1)] = 4
    shape[size > 20] = 5
    fold = lambda x: np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.int64)
    short = np.flatnonzero((kind == _LETTER) & (size >= 2) & (size <= 8))
    key = _cue_key(size[short], fold(first[short]), fold(second[short]), fold(low[np.minimum(start[short] + 2, end[short] - 1)]), fold(last[short]))
    at = np.minimum(np.searchsorted(_CUE_KEYS, key), len(_CUE_KEYS) - 1)
    hit = _CUE_KEYS[at] == key
    shape[short[hit]] = _CUE_SHAPES[at[hit]]
    d = kind == _DIGIT
    shape[d] = _DIGIT_SHAPE[np.minimum(size[d], 20)]
    if len(long):
        mixed = np.isin(start, turn[2 * long])
        shape[mixed] = np.where(size[mixed] < 2 * MIXED, N_SHAPES - 2, N_SHAPES - 1)
    o = kind == _OTHER
    shape[o] = _PUNCT_SHAPE[first[o]]
    return start, end, shape, line


def _around(shape: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Shapes of the two tokens before, the token and the two after; 0 past a line's ends."""
    out = np.zeros((len(shape), 5), dtype=np.int16)
    out[:, 2] = shape
    for k in (1, 2):
        same = line[k:] == line[:-k]
        out[k:, 2 - k][same] = shape[:-k][same]
        out[:-k, 2 + k][same] = shape[k:][same]
    return out


class Field:
    """Weights by place and shape, and transitions; label 0 is outside."""

    def __init__(self):
        self.e = np.zeros((5, N_SHAPES, len(KINDS) + 1))
        self.t = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, around: np.ndarray) -> np.ndarray:
        out = self.e[2][around[:, 2]].copy()
        for k in (0, 1, 3, 4):
            out += self.e[k][around[:, k]]
        return out

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], steps: int = 150) -> None:
        """Log likelihood with a ridge, by Adam; rows are (shapes around, labels)."""
        n = max(len(y) for _, y in rows)
        a = np.zeros((len(rows), n, 5), dtype=np.int64)
        y = np.zeros((len(rows), n), dtype=np.int64)
        live = np.zeros((len(rows), n))
        for i, (x, lab) in enumerate(rows):
            a[i, : len(lab)], y[i, : len(lab)], live[i, : len(lab)] = x, lab, 1
        k = len(KINDS) + 1
        params, m, s = [self.e, self.t], [0, 0], [0, 0]
        for step in range(1, steps + 1):
            score = sum(self.e[j][a[:, :, j]] for j in range(5)) * live[:, :, None]
            fw = np.zeros((len(rows), n, k))
            bw = np.zeros((len(rows), n, k))
            fw[:, 0] = score[:, 0]
            for i in range(1, n):
                x = np.logaddexp.reduce(fw[:, i - 1, :, None] + self.t, axis=1) + score[:, i]
                fw[:, i] = np.where(live[:, i, None] > 0, x, fw[:, i - 1])
            z = np.logaddexp.reduce(fw[:, -1], axis=1)
            for i in range(n - 2, -1, -1):
                x = np.logaddexp.reduce(self.t + (score[:, i + 1] + bw[:, i + 1])[:, None, :], axis=2)
                bw[:, i] = np.where(live[:, i + 1, None] > 0, x, 0)
            p = np.exp(fw + bw - z[:, None, None]) * live[:, :, None]
            hot = np.zeros_like(p)
            np.put_along_axis(hot, y[:, :, None], 1, axis=2)
            diff = hot * live[:, :, None] - p
            ge = np.zeros_like(self.e)
            for j in range(5):
                np.add.at(ge[j], a[:, :, j].ravel(), diff.reshape(-1, k))
            gt = np.zeros_like(self.t)
            for i in range(1, n):
                on = live[:, i] > 0
                pair = np.exp(fw[:, i - 1, :, None] + self.t + (score[:, i] + bw[:, i])[:, None, :] - z[:, None, None])
                gt -= pair[on].sum(axis=0)
                np.add.at(gt, (y[on, i - 1], y[on, i]), 1)
            for q, (w, g) in enumerate(zip(params, (ge - 0.05 * self.e, gt - 0.05 * self.t))):
                m[q] = 0.9 * m[q] + 0.1 * g
                s[q] = 0.99 * s[q] + 0.01 * g * g
                w += 0.08 * (m[q] / (1 - 0.9**step)) / (np.sqrt(s[q] / (1 - 0.99**step)) + 1e-8)

    def decode(self, score: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Viterbi over all lines together, in order of falling length."""
        head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.r_[head, len(line)])
        order = np.argsort(-size, kind="stable")
        head, size = head[order], size[order]
        out = np.zeros(len(line), dtype=np.int8)
        best = score[head]
        back = []
        for i in range(1, int(size[0])):
            n = int(np.count_nonzero(size > i))
            x = best[:n, :, None] + self.t
            back.append(x.argmax(axis=1).astype(np.int8))
            best[:n] = x.max(axis=1) + score[head[:n] + i]
        lab = best.argmax(axis=1).astype(np.int8)
        for i in range(int(size[0]) - 1, -1, -1):
            n = int(np.count_nonzero(size > i))
            out[head[:n] + i] = lab[:n]
            if i:
                lab[:n] = back[i - 1][np.arange(n), lab[:n]]
        return out


@cache
def trained() -> Field:
    rows = []
    for text in LABELLED:
        plain, marks, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", text):
            plain += text[at : m.start()]
            marks.append((KINDS.index(m[1]) + 1, len(plain), len(plain) + len(m[2])))
            plain += m[2]
            at = m.end()
        plain += text[at:]
        start, end, shape, line = tokens(np.array([ord(c) for c in plain], dtype=np.uint32))
        label = np.zeros(len(start), dtype=np.int64)
        for k, lo, hi in marks:
            label[(start >= lo) & (end <= hi)] = k
        rows.append((_around(shape, line), label))
    f = Field()
    f.fit(rows)
    return f


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four patterns, leftmost and not overlapping within a kind. A match
    that fails its test is dropped and what it covered is not tried again."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        m = DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            done = m.end()
        else:
            done = at + 1  # no local part reaches across another @
        at = text.find("@", max(done, at + 1))
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = [int(c) for c in m[0] if "0" <= c <= "9"] if m.end() - m.start() <= 38 else []
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


TITLE = re.compile(r"(?i)(?:\b(?:mr|mrs|ms|dr)\.?|\bname is)\s*\Z")


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plausible(kind: str, text: str, lo: int, hi: int) -> bool:
    """The exact check on what the field labels."""
    part = text[lo:hi]
    digits = [int(c) for c in part if "0" <= c <= "9"]
    if kind == "email":
        return bool(re.search(r"(?i)(@|\W+at\W+).*(\.|\W+dot\W+)\w", part)) and len(part) <= 120
    if kind == "ip":
        return bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", part)) and all(int(x) <= 255 for x in part.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "id":
        return len(digits) >= 6 and len(part) <= 42
    if kind == "name":
        return bool(re.match(r"(?i)(mr|mrs|ms|dr)\b", part) or TITLE.search(text[max(0, lo - 12) : lo])) and len(part) <= 60
    return len(part) >= 8 and bool(digits) and any(c.isalpha() for c in part)


#: what a key or a number of letters and digits goes on with
UNBROKEN = {"secret": re.compile(r"[A-Za-z0-9_+/-]*"), "id": re.compile(r"[A-Za-z0-9]*")}


def whole(kind: str, text: str, lo: int, hi: int) -> tuple[int, int]:
    """The span widened to the unbroken string around it, so that no rest of a key stays."""
    if kind in UNBROKEN:
        hi = UNBROKEN[kind].match(text, hi).end()
        while lo and UNBROKEN[kind].fullmatch(text, lo - 1, lo):
            lo -= 1
    return lo, hi


#: code points worked on at a time; lines are never cut
CHUNK = 1 << 20


def field_spans(texts: list[str], f: Field | None = None) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the random field labels."""
    f = f or trained()
    bonus = max(0.0, float((f.t - f.t[0, 0]).max())) + max(0.0, float((f.t[:, 0] - f.t[0, 0]).max()))
    out: list[list] = [[] for _ in texts]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < CHUNK):
            size += len(texts[hi]) + 1
            hi += 1
        points = np.frombuffer("\n".join(texts[lo:hi]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        edge = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        start, end, shape, line = tokens(points)
        if len(start):
            around = _around(shape, line)
            # a bound for each token from tables, then whole lines around those that may matter
            gain = sum(_gain(f)[k][around[:, k]] for k in range(5))
            busy = np.unique(line[gain + bonus > 0])
            at = np.flatnonzero(np.isin(line, busy)) if len(busy) < 0.9 * (line[-1] + 1) else np.arange(len(line))
            if len(at):
                label = f.decode(f.scores(around[at]), line[at])
                on = np.flatnonzero(label)
                if len(on):
                    cut = np.flatnonzero((np.diff(on) > 1) | (np.diff(label[on]) != 0) | (np.diff(line[at][on]) != 0)) + 1
                    for run in np.split(on, cut):
                        a, b = int(start[at[run[0]]]), int(end[at[run[-1]]])
                        r = int(np.searchsorted(edge, a, side="right")) - 1
                        kind, a, b = KINDS[label[run[0]] - 1], a - int(edge[r]), b - int(edge[r])
                        last = out[lo + r][-1] if out[lo + r] else ("", 0, 0)
                        if last[0] == kind and b <= last[2]:
                            continue  # inside the string that was taken whole
                        a, b = whole(kind, texts[lo + r], a, b)
                        if plausible(kind, texts[lo + r], a, b):
                            out[lo + r].append((kind, a, b))
        lo = hi
    return out


def _gain(f: Field) -> np.ndarray:
    """By place and shape, the most any label gains over outside."""
    if not hasattr(f, "gain"):
        f.gain = (f.e[:, :, 1:] - f.e[:, :, :1]).max(axis=2)
    return f.gain


def spans(texts: list[str], f: Field | None = None) -> tuple[list[list], list[list]]:
    """Base spans and all spans of each text. A field span that meets a base span is left
    out."""
    order = lambda s: (s[1], KINDS.index(s[0]))
    base = [sorted(base_spans(t), key=order) for t in texts]
    every = []
    for b, more in zip(base, field_spans(texts, f)):
        free = [s for s in more if not any(s[1] < e and a < s[2] for _, a, e in b)] if b else more
        every.append(sorted(b + free, key=order))
    return base, every


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, then n_email, n_ip, n_card, n_phone (base matches), base_sha256,
    spans (kind:start:end, code points, by start and kind) and n_spans, how many there are. A
    scan without a shuffle. A null text is an empty one. Repeated rows give equal results. A
    very long text is worked on whole, with some forty bytes a code point. An empty table
    gives an empty table. Columns of those names are replaced."""
    kinds = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    names = [x.split()[0] for x in kinds.split(", ")]
    field = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf(kinds)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out = []
            for b, all_ in zip(*spans([t or "" for t in series], field.value)):
                n = [sum(s[0] == k for s in b) for k in BASE]
                out.append((*n, hashlib.sha256(_joined(b).encode()).hexdigest(), _joined(all_), len(all_)))
            yield pd.DataFrame(out, columns=names)

    return docs.drop(*names).withColumn("__ply_p", scan(text)).select("*", "__ply_p.*").drop("__ply_p")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of ``text`` replaced by its kind in angle brackets; spans that
    overlap are merged under the first one's kind. Null stays null."""

    @F.pandas_udf("string")
    def cover(series: pd.Series) -> pd.Series:
        out = []
        for t, (_, all_) in zip(series, zip(*spans([x or "" for x in series])) if len(series) else ()):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for k, a, b in all_:
                if a >= at:
                    parts += [t[at:a], f"<{k}>"]
                at = max(at, b)
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cover(text))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
