"""Line, document and vector deduplication, and decontamination, against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from plyframe.llm import common, decontaminate, jaccard, linededup, simhash, vectors
from plyframe.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: extra columns whose names the operators use inside
CLASH = ["fp", "key", "hash", "h", "at", "u", "picks", "text_hash", "root", "node", "a", "b", "n", "kept", "hits", "marks", "__x", "_d", "_t", "_h", "n_words"]


def table(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    for c in CLASH if clash else []:
        df = df.selectExpr("*", f"'x' as {c}")
    return df


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


# --- components --------------------------------------------------------------------------

@pytest.mark.parametrize("few", [1 << 20, -1])
def test_components_of_a_long_chain_and_nulls(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- SimHash -----------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_the_definition():
    r = random.Random(3)
    for text in [None, "", " \n", "One", "One TWO", "a b c", "É è x ß", *(prose(r, n) for n in (3, 4, 50, 400))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_keys_share_one_for_words_a_bit_apart():
    keys = simhash.golay_keys()
    r = random.Random(1)
    for _ in range(3000):
        v = r.randrange(1 << 16)
        w = v ^ 1 << r.randrange(16)
        assert set(keys[v][keys[v] >= 0]) & set(keys[w][keys[w] >= 0])


def test_every_pair_within_three_bits_shares_a_key():
    r = random.Random(2)
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(1, 3)):
            b ^= 1 << bit
        at, key = simhash.keys_of(np.array([a, b], dtype=np.uint64))
        assert set(key[at == 0]) & set(key[at == 1])


def test_links_against_brute_force(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for k in (1, 2, 3, 4):
            g = f
            for bit in r.sample(range(64), k):
                g ^= 1 << bit
            fps.append(g)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {(x.a, x.b) for x in got.collect()} == want


def test_simhash_edges(spark):
    long = "word " * 200_000
    rows = [(5, None), (3, ""), (9, " \n"), (7, "same text here now"), (2, "Same TEXT here now"), (2, "Same TEXT here now"), (None, "alone"), (8, long)]
    got = [tuple(r) for r in simhash.near_duplicates(table(spark, rows, clash=True)).select("doc_id", "component_id").collect()]
    assert sorted(got, key=str) == sorted([(5, 3), (3, 3), (9, 3), (7, 2), (2, 2), (2, 2), (None, None), (8, 8)], key=str)
    kept = simhash.keep_one(table(spark, rows, clash=True))
    assert kept.columns == table(spark, [], clash=True).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 2, 8, None], key=str)
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def plain_jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


def near_copies(seed, n=90):
    """Texts with changed words, so that many pairs lie on both sides of 0.8."""
    r = random.Random(seed)
    line, texts = prose(r, 9), []
    for _ in range(n):
        base = prose(r, r.choice((3, 6, 40, 150))).split() + line.split()
        for k in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = "changed" + str(r.random())[2:]
            texts.append(" ".join(w))
    return list(dict.fromkeys(texts))


def test_similar_texts_against_brute_force(spark, monkeypatch):
    texts = near_copies(21)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if plain_jaccard(texts[i], texts[j]) >= 0.8]
    assert len(pairs) > 30
    want = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    rows = spark.createDataFrame([(t, t, x) for t, x in [*enumerate(texts), (0, texts[0])]], "doc_id long, t long, text string").selectExpr("doc_id", "t", "cast(text as binary) as text")
    marks = simhash._marks(rows, jaccard.frequent(rows.select("t", "text"))).cache()
    none = spark.createDataFrame([], "a long, b long")
    for crowded in (jaccard.CROWDED, -1):  # in pairs, and all in tiles
        monkeypatch.setattr(jaccard, "CROWDED", crowded)
        monkeypatch.setattr(jaccard, "BLOCK", 7)
        found = jaccard.links(marks, rows.select("t", "text"), none).collect()
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in found} <= set(pairs)
        assert {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()} == want


def test_sketches_pass_every_similar_pair():
    texts = near_copies(23, 40) + [prose(random.Random(4), 4000), ""]
    sets = [np.unique(jaccard.shingles(t.encode())) for t in texts]
    sketches = [jaccard.sketch(s) for s in sets]
    passed = close = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            ok = jaccard.may_be_similar(len(a), sketches[i], len(b), sketches[j])
            assert ok or not jaccard.similar(a, b)
            passed, close = passed + ok, close + jaccard.similar(a, b)
    assert close <= passed < 2 * close


def test_keep_one_takes_near_copies_at_four_fifths(spark):
    texts = near_copies(22)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if plain_jaccard(texts[i], texts[j]) >= 0.8]
    fps = [simhash.fingerprint(t) for t in texts]
    assert any((fps[i] ^ fps[j]).bit_count() > 8 for i, j in pairs)
    pairs += [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    kept = {r.doc_id for r in simhash.keep_one(table(spark, list(enumerate(texts)))).collect()}
    assert kept == {i for i in range(len(texts)) if root.get(i, i) == i}


def test_keep_one_goes_by_rows(spark):
    """An id with two texts keeps both; rows without an id are copies like any other."""
    r = random.Random(8)
    x, y, z = prose(r, 50), prose(r, 60), prose(r, 70)
    rows = [(1, x), (1, y), (2, x), (None, x), (None, z), (None, z), (5, None), (6, ""), (None, "\t")]
    kept = simhash.keep_one(table(spark, rows, clash=True)).collect()
    assert sorted(((k.doc_id, k.text) for k in kept), key=str) == sorted([(1, x), (1, y), (None, z), (5, None)], key=str)
    assert simhash.keep_one(table(spark, [])).count() == 0


# --- line deduplication ------------------------------------------------------------------

def words_of(line):
    return 0 if not line.strip() else line.count(" ") + 1


def passages(text, least):
    """All stretches of whole non-empty lines with at least so many words, shortest from
    each line."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    for i in range(len(lines)):
        n = 0
        for j in range(i, len(lines)):
            n += words_of(lines[j])
            if n >= least:
                yield tuple(lines[i : j + 1])
                break


def test_lines_no_passage_stays_twice_and_nothing_is_lost(spark):
    r = random.Random(11)
    stock = [[prose(r, r.randint(2, 60)) for _ in range(r.randint(1, 6))] for _ in range(12)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 5)):
            lines += r.choice(stock) if r.random() < 0.5 else [prose(r, r.randint(1, 50)), ""]
        docs.append((i, "\n".join(lines)))
    got = {x.doc_id: x for x in linededup.deduplicate(table(spark, docs)).collect()}
    seen, kept = {}, set()
    for i, text in docs:
        original = "\n" + "\n".join(x for x in text.split("\n") if x.strip()) + "\n"
        for p in set(passages(got[i].text, linededup.PASSAGE_WORDS)):
            if "\n" + "\n".join(p) + "\n" in original:
                assert p not in seen, (i, seen.get(p))
                seen[p] = i
        kept |= set(got[i].text.split("\n"))
    for i, text in docs:
        assert {x for x in text.split("\n") if x.strip()} <= kept
        # only lines of repeated runs go
        if not got[i].n_removed:
            assert got[i].text == text


def test_lines_first_copy_stays_whole(spark):
    r = random.Random(4)
    a, b, own = prose(r, 60), prose(r, 55), prose(r, 30)
    rows = [(1, f"{a}\n{b}"), (2, f"{own}\n{a}\n\n{b}\nend"), (3, f"{a}\n{b}"), (4, f"{a}\nx\n{a}")]
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed, x.sources) for x in linededup.deduplicate(table(spark, rows, clash=True)).collect()}
    assert got == {1: (f"{a}\n{b}", 2, 0, []), 2: (f"{own}\nend", 5, 3, [1]), 3: ("", 2, 2, [1]), 4: ("x", 3, 2, [1, 4])}
    left = linededup.without_repeats(table(spark, rows, clash=True))
    assert left.columns == table(spark, [], clash=True).columns
    assert {x.doc_id: x.n_chars for x in left.collect()} == {1: len(a) + len(b) + 1, 2: len(own) + 4, 4: 1}


def test_lines_edges(spark):
    r = random.Random(6)
    p = prose(r, 80)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, p), (4, p), (None, p), (5, "short\nshort"), (6, "\n".join([p] * 3000))]
    got = sorted(((x.doc_id, x.text, x.n_removed) for x in linededup.deduplicate(table(spark, rows)).collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, "\n\n", 0), (4, "", 1), (4, "", 1), (None, p, 0), (5, "short\nshort", 0), (6, "", 3000)]
    assert got == sorted(want, key=str)
    assert linededup.deduplicate(table(spark, [])).count() == 0


def repeated_lines(docs):
    """(id, line) of all lines in a stretch of PASSAGE_WORDS words that occurs before."""
    seen, out = set(), set()
    for i, text in docs:
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(map(words_of, lines[a : b + 1])) >= linededup.PASSAGE_WORDS:
                    p = tuple(lines[a : b + 1])
                    if p in seen:
                        out |= {(i, k) for k in range(a, b + 1)}
                    seen.add(p)
    return out


def test_lines_all_of_a_repeated_stretch_go(spark):
    """Also where its selected run stands in a document before, without the rest."""
    r = random.Random(17)
    x, y, z = prose(r, 59), prose(r, 39), prose(r, 11)
    docs = [(1, f"{x}\n{prose(r, 8)}"), (2, f"{z}\n{y}\n{x}"), (3, f"{z}\n{y}\n{x}"), (4, f"{x}\n{z}")]
    docs += [(5, f"{x}\n{prose(r, 3)}\n{y}\n{x}\n{z}")]
    stock = [prose(r, n) for n in (3, 9, 20, 30, 45, 60)]
    docs += [(10 + k, "\n".join(r.choice(stock) for _ in range(r.randint(1, 9)))) for k in range(60)]
    want = repeated_lines(docs)
    got = {d.doc_id: d.text for d in linededup.deduplicate(table(spark, docs)).collect()}
    for i, text in docs:
        assert got[i] == "\n".join(t for k, t in enumerate(text.split("\n")) if (i, k) not in want), i
    assert got[3] == ""


# --- decontamination ---------------------------------------------------------------------

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_decontaminate(docs, items):
    out = []
    for i, text in docs:
        w = plain_words(text)
        hit, who = set(), set()
        for item, body in items:
            v = plain_words(body)
            size = min(10, len(v))
            if item is None or not v:
                continue
            for k in range(len(v) - size + 1):
                for q in range(len(w) - size + 1):
                    if w[q : q + size] == v[k : k + size]:
                        hit |= set(range(q, q + size))
                        who.add(str(item))
        out.append((i, len(w), len(hit), len(who)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(r, n)) for i, n in enumerate((12, 30, 10, 9, 4, 1, 25))] + [(50, None), (51, "--"), (None, prose(r, 15)), (0, "x y z x y z x y z x y z x y z")]
    docs = [(99, "x y z " * 9), (98, None), (97, "...")]
    for i in range(40):
        parts = [prose(r, r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").upper().split()
            a = r.randrange(max(1, len(w)))
            parts += [" ".join(w[a : a + r.randint(5, 30)]), prose(r, 5)]
        docs.append((i, ", ".join(parts)))
    docs.append(docs[-1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(table(spark, docs, clash=True), bench)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items) for x in got.collect()), key=str) == plain_decontaminate(docs, items)
    left = decontaminate.clean(table(spark, docs, clash=True), bench)
    assert left.columns == table(spark, [], clash=True).columns
    assert sorted((x.doc_id for x in left.collect()), key=str) == sorted((i for i, _, n, _ in plain_decontaminate(docs, items) if not n), key=str)


def test_long_texts_in_stretches(spark, monkeypatch):
    """The same result where stretches are short; a word that never ends is read whole."""
    r = random.Random(12)
    items = [(i, prose(r, n)) for i, n in enumerate((12, 30, 10, 4, 25))]
    docs = [(0, "x" * 5000)]
    for i in range(1, 12):
        parts = []
        for _ in range(r.randint(5, 30)):
            parts += [prose(r, r.randint(1, 40)), r.choice(items)[1]]
        docs.append((i, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_decontaminate(docs, items)
    assert sum(n for _, _, n, _ in want) > 500
    monkeypatch.setattr(decontaminate, "CHUNK", 300)
    bytes_ = [t.encode() for _, t in docs]
    widths, everything = [5], np.full((1 << decontaminate.FILTER_BITS) // 8 + 4096, 255, dtype=np.uint8)
    counted = [0] * len(docs)
    for lo, _, _, _, _, n, found in decontaminate._scan(bytes_, widths, everything):
        for k, x in enumerate(n):
            counted[lo + k] += x
    assert counted == [len(plain_words(t)) for _, t in docs]
    places = [set() for _ in docs]
    for lo, data, words, row, number, _, found in decontaminate._scan(bytes_, widths, everything):
        total = np.bincount(row, minlength=len(number))
        for _, at, _ in found:
            for i in at.tolist():
                q = i - int((np.cumsum(total) - total)[row[i]]) + number[row[i]]
                assert q not in places[lo + row[i]]
                places[lo + row[i]].add(q)
    assert [len(p) for p in places] == [max(0, n - 4) for n in counted]
    for text in bytes_[1:]:
        for data, words, number, own, upto in decontaminate._pieces(text):
            n = len(words.start)
            assert (number == 0 and own == 0) or own == decontaminate.WINDOW - 1
            assert upto == n or n - upto == decontaminate.WINDOW - 1


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.contaminated) for x in decontaminate.decontaminate(table(spark, [(1, "a b")]), none).collect()] == [(2, False)]
    assert decontaminate.decontaminate(table(spark, []), none).count() == 0


# --- vectors -----------------------------------------------------------------------------

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 24))
    rows = []
    for i in range(400):
        v = base[i % 30] + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.25, 0.3])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 30 % 3)))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(5)]  # equal vectors
    m = np.array([v for _, v, _ in rows], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([x[2] for x in rows])
    link = (m @ m.T >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(r.n_links for r in got.values())
    assert link.sum() > 500 and found <= link.sum()
    assert found >= 0.97 * link.sum()  # many pairs here lie close to the threshold
    tight = (m @ m.T >= 0.97) & link
    for k, (i, _, _) in enumerate(rows):
        assert tight[k].sum() <= got[i].n_links <= link[k].sum()
        assert got[i].kept == (got[i].component_id == i)


def test_no_link_at_the_threshold_is_lost(spark):
    """Pairs a little above 0.93, which shared no bucket of signs now and then."""
    rng = np.random.default_rng(15)
    rows = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b *= np.sqrt(1 - 0.931**2) / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (0.931 * a + b).tolist(), 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (1, i - i % 2) for i in range(800)}


def test_bounds_never_drop_a_link():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 64))
    b = a + rng.normal(size=a.shape) * 0.38
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    _, factor = vectors.encode(a)
    i, j = vectors.linked_pairs(a, b, factor)
    want = np.argwhere(a @ b.T >= vectors.THRESHOLD)
    assert len(want) > 50 and sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("clash", [False, True])
def test_vector_edges(spark, clash):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0)]
    rows += [(8, [1.0, None], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("h", "v", "rid", "times", "slot", "n", "a") if clash else ():
        df = df.selectExpr("*", f"'x' as {c}")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (None, 0, None, True), *alone], key=str)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_double_vectors_keep_their_precision(spark):
    rows = [(1, [1.0, 1e-9], 0), (2, [1.0, 2e-9], 0), (3, [1e200, 0.0], 0), (4, [0.0, 1e-200], 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_large_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    rows = [(i, (centre + rng.normal(size=32) * 0.02).astype(np.float32).tolist(), 0) for i in range(120)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


def test_tiles_with_an_empty_block_count_nothing_twice(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 2)
    rng = np.random.default_rng(14)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(40)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(39, 0)}
