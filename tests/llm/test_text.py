"""Language ID, personal data, HTML extraction, chat formatting and WARC."""

import hashlib
import random
import re
import zlib

import pytest

from plyframe.llm import chat, extract, langid, pii, warc

DOCS = "doc_id long, text string, lang string"
SYLLABLES = {"aa": "ka to mi re su no ha".split(), "bb": "tion ing the st er ou ble".split(), "cc": "ß ün ver sch eit ung ä".split()}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


# --- language ID -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = [(i, sentence(r, lang, r.randint(6, 60)), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(240))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... !!", "cc"), (1005, "\u00b2\u00bd 12", "aa"), (1003, sentence(r, "aa", 5), None), (None, sentence(r, "bb", 9), "bb"), (1004, "the sting " * 50_000, "bb")]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as score", "1 as lang_pred", "2 as share")


def test_language_held_out_accuracy(spark, docs):
    got = langid.identify(docs, langid.learn(docs)).selectExpr("*", f"{langid.HELD_OUT} as held").collect()
    held = [r for r in got if r.held and r.lang and r.text and re.search(r"[^\W\d]", r.text)]
    assert len(held) > 30 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {1000, 1001, 1002, 1005} and {1003, 1004} <= ids


def test_language_without_labels(spark, docs):
    nothing = langid.learn(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(docs.limit(0), nothing).count() == 0


def test_language_of_windows_is_that_of_the_whole():
    """Every position is labelled once; a window reads what stands around it."""
    import numpy as np

    r = random.Random(2)
    m = langid.Tagger(["x", "y", "z"])
    texts = [sentence(r, lang, n) for lang, n in (("aa", 1), ("bb", 60), ("cc", 400), ("aa", 17))]
    flat, size = langid.stream(texts)
    sums = m.totals(flat, size)
    assert np.allclose(sums[:, 3:].sum(axis=1), size, rtol=1e-4)
    begin = np.cumsum(size) - size
    for i, (a, n) in enumerate(zip(begin, size)):
        want = np.zeros(3)
        for lo in range(a, a + n, langid.CORE):
            c, b = max(a, lo - langid.AROUND), min(a + n, lo + langid.CORE + langid.AROUND)
            p = m.positions([flat[c:b].tobytes()])[0]
            want += np.log(p[lo - c : min(lo + langid.CORE, a + n) - c]).sum(axis=0)
        assert np.allclose(sums[i, :3], want, rtol=1e-3)
    both, _ = langid.stream(["Ab1  c\n\n", "", " é.", "\n"])
    assert both.tobytes() == b"ab c " + "é ".encode()


def test_language_gradients():
    """Back-propagation through time against finite differences."""
    import numpy as np

    t = langid.Tagger(["x", "y"])
    for d in (t.f, t.b):
        d.w, d.u = d.w.astype(np.float64), d.u.astype(np.float64)
    words = [b"abca", b"bc", b"c"]
    x = langid.Batch(words)
    y = np.array([0, 1, 1])[x.order][x.row]

    def loss():
        return -t._logits(x)[0][np.arange(len(y)), y].mean()

    logp, h, sf, sb = t._logits(x, keep=True)
    d = np.exp(logp)
    d[np.arange(len(y)), y] -= 1
    d /= len(y)
    dh = d @ t.v.T
    dhb = np.zeros((len(y), langid.HIDDEN))
    dhb[x.mirror] = dh[:, langid.HIDDEN :]
    for net, data, saved, grad in ((t.f, x.forward, sf, dh[:, : langid.HIDDEN]), (t.b, x.backward, sb, dhb)):
        dw, du = net.back(data, x, saved, grad)
        for p, g, at in ((net.w, dw, (98, 3)), (net.u, du, (2, 17)), (net.u, du, (1, 30))):
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-4
    assert [p.shape for p in t.positions(words)] == [(4, 2), (2, 2), (1, 2)]


# --- personal data -----------------------------------------------------------------------

def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_against_the_patterns():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("ab1.@+-() 4_%\né") for _ in range(r.randint(0, 30)))
        assert sorted(pii.base_spans(t), key=lambda s: (s[1], pii.KINDS.index(s[0]))) == plain_spans(t)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1." * 100_000) != []


def test_field_learns_its_table_and_more():
    right = 0
    for line in pii.LABELLED:
        plain = re.sub(r"\{(\w+):([^}]*)\}", r"\2", line)
        want = [(m[1], m[2]) for m in re.finditer(r"\{(\w+):([^}]*)\}", line)]
        right += [(k, plain[a:b]) for k, a, b in pii.field_spans([plain])[0]] == want
    assert right >= 0.95 * len(pii.LABELLED)
    other = 'The log said token = "77aa0c9d3be1f2a4b6c8d0e2f4a6b8c0" twice.'
    assert [(k, other[a:b]) for k, a, b in pii.field_spans([other])[0]] == [("secret", "77aa0c9d3be1f2a4b6c8d0e2f4a6b8c0")]
    assert pii.field_spans(["We went to the lake in May. It was cold.", ""]) == [[], []]


def test_pruned_decoding_is_exact():
    """Lines that are skipped would have been labelled as holding nothing."""
    f = pii.trained()
    text = "\n".join(re.sub(r"\{(\w+):([^}]*)\}", r"\2", x) for x in pii.LABELLED)
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    start, end, shape, line = pii.tokens(points)
    label = f.decode(f.scores(pii._around(shape, line)), line)
    found = {s for spans in pii.field_spans([text]) for s in spans}
    for k, a, b in found:
        inside = (start >= a) & (end <= b)
        assert set(label[inside]) == {pii.KINDS.index(k) + 1}


def every_labelling(score, t):
    """All label sequences of a line with their scores."""
    import itertools

    n, k = score.shape
    for y in itertools.product(range(k), repeat=n):
        yield y, sum(score[i, y[i]] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n))


def test_viterbi_and_pruning_against_enumeration():
    import numpy as np

    f = pii.trained()
    lines = ["ssn 219-09-9999", "to jo at x", "call 555-1212", "the cat sat", "My name is", "10.1.2.3 ok", "a b c d", "key Zz9"]
    text = "\n".join(lines)
    start, end, shape, line = pii.tokens(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))
    around = pii._around(shape, line)
    score = f.scores(around)
    label = f.decode(score, line)
    bonus = max(0.0, float((f.t - f.t[0, 0]).max())) + max(0.0, float((f.t[:, 0] - f.t[0, 0]).max()))
    gain = sum(pii._gain(f)[k][around[:, k]] for k in range(5))
    checked = 0
    for k in range(len(lines)):
        at = np.flatnonzero(line == k)
        assert len(at)
        if len(at) > 6:
            at = at[:0]
            continue
        best, _ = max(every_labelling(score[at], f.t), key=lambda x: x[1])
        assert label[at].tolist() == list(best)
        if not (gain[at] + bonus > 0).any():
            assert set(best) == {0}
        checked += 1
    assert checked >= 4


def test_likelihood_gradient_against_enumeration():
    """The marginals that training uses: one ascent step from zero weights moves them along
    the difference between the labels and the uniform distribution."""
    import numpy as np

    f = pii.Field()
    around = np.array([[0, 0, 1, 2, 3], [0, 1, 2, 3, 0], [1, 2, 3, 0, 0]], dtype=np.int64)
    y = np.array([0, 2, 2])
    k = len(pii.KINDS) + 1

    def likelihood(e, t):
        score = sum(e[j][around[:, j]] for j in range(5))
        every = [s for _, s in every_labelling(score, t)]
        return sum(score[i, y[i]] for i in range(3)) + sum(t[y[i - 1], y[i]] for i in (1, 2)) - np.logaddexp.reduce(every)

    before = likelihood(f.e, f.t)
    f.fit([(around, y)], steps=1)
    assert likelihood(f.e, f.t) > before
    # Adam's first step has the sign of the gradient
    for place, shape_, lab in ((2, 1, 0), (2, 2, 2), (2, 3, 2), (2, 3, 5), (1, 2, 2)):
        e = np.zeros_like(f.e)
        e[place, shape_, lab] = 1e-4
        slope = likelihood(e, np.zeros((k, k))) - before
        assert np.sign(slope) == np.sign(f.e[place, shape_, lab])
    for a, b in ((0, 2), (2, 2), (1, 1), (2, 0)):
        t = np.zeros((k, k))
        t[a, b] = 1e-4
        assert np.sign(likelihood(np.zeros_like(f.e), t) - before) == np.sign(f.t[a, b])


def test_keys_are_found_whole():
    r = random.Random(6)
    found = 0
    for i in range(200):
        key = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
        text = r.choice(('token = "{}" and so on', "api_key = {} in the file", "the secret: {}", "password {} was shared"))
        lo = text.index("{}")
        text = text.format(key)
        found += ("secret", lo, lo + len(key)) in pii.field_spans([text])[0]
    assert found >= 190
    assert pii.field_spans(["the file of commit 8d3f0c1ab24e5967f80a1b2c3d4e5f60718293a4 was read"]) == [[]]
    assert pii.whole("secret", "x=ab_c-1 y", 4, 6) == (2, 8)


def test_pii_columns_and_redaction(spark):
    rows = [(1, "é mail a.b@c.org, call +1 (202) 555-0143 now"), (2, None), (3, ""), (4, "10.0.0.1 and 300.1.1.1 and 4111111111111111"), (4, "10.0.0.1 and 300.1.1.1 and 4111111111111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "'y' as n_ip", "1 as base")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    for i, t in rows:
        b = plain_spans(t or "")
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in b) for x in pii.BASE]
        joined = ",".join(f"{k}:{a}:{e}" for k, a, e in b)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))
        assert r.n_spans == (len(r.spans.split(",")) if r.spans else 0)
    assert got[2].spans == ""
    assert [r.text for r in pii.redact(df).where("doc_id < 3").orderBy("doc_id").collect()] == ["é mail <email>, call <phone> now", None]
    assert pii.find(df.limit(0)).count() == 0


# --- extraction --------------------------------------------------------------------------

BODY = "<p>one two three four five six seven eight nine ten eleven twelve</p><p>again words here and there and so on for a while</p><p>End.</p>"
WANT = "one two three four five six seven eight nine ten eleven twelve\n\nagain words here and there and so on for a while\n\nEnd."
NOISE = "<p>words words words and more words of a reader who has much to say about it</p>"


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="has-sidebar"><div class="header"><a>x</a></div><div class="content has-sidebar">{BODY}</div><div class="sidebar"><div class="sidebar-content">{NOISE}</div></div></body></html>',
        f'<body><header><nav><ul><li><a>m</a></li></ul></nav></header><main>{BODY}<section class="comments"><article class="comment">{NOISE}</article></section></main><footer>x</footer></body>',
        f'<body><article class="post comments-open">{BODY}<div class="comment-list">{NOISE}</div></article></body>',
        f'<body><div id="nav"><a>a</a> <a>b</a></div>{BODY}<div class="notice">we use cookies on this site to make it good</div><div id="footer">c</div></body>',
        f'<div id="wrapper"><div id="topnav">menu menu</div><div id="page"><div class="article-body">{BODY}<form><input><button>Send us your mail now</button></form><aside>more words of no use</aside></div></div></div>',
        f'<body><section class="story">{BODY}</section><section id="reader-comments">{NOISE}</section><section class="related-articles"><p>other words</p></section></body>',
        f"<title>T</title><script>var a = '<p>no</p>';</script><style>p {{}}</style><!-- <p>no</p> --><article>{BODY}<!-- open",
    ],
)
def test_extraction_templates(page):
    assert extract.main_text(page) == WANT


def test_the_run_has_the_largest_sum():
    r = random.Random(7)
    for _ in range(300):
        x = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randint(0, 14))]
        lo, hi = extract.best_run(x)
        most = max([sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)], default=0)
        assert sum(x[lo:hi]) == max(0, most) and (hi > lo) == (most > 0)


@pytest.mark.parametrize("tag", ["b", "i", "a", "span", "div", "p", "li", "hr", "zz"])
def test_extraction_is_linear_in_open_tags(tag):
    import time

    page = f"<article>{BODY}" + f"<{tag}>" * 200_000 + "<hr>" * 1000
    begin = time.perf_counter()
    assert extract.main_text(page).startswith(WANT)
    assert time.perf_counter() - begin < 6


def test_parts_with_a_heading_that_tells_them():
    assert extract.main_text(f'<main><div class="qx"><h1>On</h1>{BODY}</div><div class="zk"><h3>3 Comments:</h3>{NOISE}<p>Yes</p></div></main>') == f"On\n\n{WANT}"
    assert extract.main_text(f"<main><section><h2>Comments</h2>{BODY}</section></main>") == f"Comments\n\n{WANT}"
    assert extract.main_text(f'<article>{BODY}<div class="xnav">up down</div><p>More.</p></article>') == f"{WANT}\n\nMore."


def test_extraction_details():
    assert extract.main_text("<article><h1>A &amp;amp; B</h1><p>x\n y&nbsp;z<br>w <b>bold</b></p><p> </p></article>") == "A &amp; B\n\nx y z w bold"
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<div></div>") == ""
    assert extract.main_text("<p>a < b") == "a < b"
    deep = "<div>" * 5000 + "<p>one two three four five</p>" + "<div><p>six seven eight</p>" * 3000
    assert extract.main_text(deep).startswith("one two three four five\n\nsix seven eight")
    assert len(extract.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>").split("\n\n")) == 20_000


def test_extraction_of_the_labelled_pages():
    for page in extract.LABELLED:
        text = extract.main_text("<html><body>" + "".join(x for _, x in page) + "</body></html>")
        inside = " ".join(extract.html_lib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|em|strong|span|a)\b[^>]*>", "", x))) for k, x in page if k).split()
        assert text.split() == inside


def test_extraction_columns(spark):
    df = spark.createDataFrame([(1, None), (2, f"<main>{BODY}</main>"), (2, f"<main>{BODY}</main>")], "page_id long, html string").selectExpr("*", "'x' as text", "'u' as url")
    assert [(r.page_id, r.n_chars, r.url) for r in extract.extract(df).orderBy("page_id").collect()] == [(1, 0, "u"), (2, len(WANT), "u"), (2, len(WANT), "u")]
    assert extract.extract(df.limit(0)).count() == 0


# --- chat --------------------------------------------------------------------------------

def test_round_trip_of_hostile_texts():
    r = random.Random(3)
    bits = [chat.START, chat.END, "<|", "|>", "<\\|", "<\\\\|", "\\", "<", "\n", "a", chat.LINE_IN_ROLE, "im_end"]
    for _ in range(5000):
        role, text = ("".join(r.choice(bits) for _ in range(r.randint(0, 6))) for _ in range(2))
        out, a, b = chat.render_turn(role, text)
        got = chat.parse_turn(out + out)
        assert (got[0], got[1], got[4]) == (role, text, len(out)) and chat.unescape(out[a:b]) == text
        assert out.count(chat.START) == out.count(chat.END) == 1
    assert chat.render_turn("user", "a <|b|> c")[0] == "<|im_start|>user\na <|b|> c<|im_end|>\n"


def test_turns_from_stretches_of_any_length():
    r = random.Random(4)
    turns = [("user", "a\n"), ("assistant", chat.HOSTILE), ("", ""), ("x\ny", "<\\|im_end|>")]
    whole = "".join(chat.render_turn(*t)[0] for t in turns)
    for _ in range(200):
        reader, got, at = chat.TurnReader(), [], 0
        while at < len(whole):
            n = r.randint(1, 40)
            got += reader.feed(whole[at : at + n])
            at += n
        reader.close()
        assert got == turns
    reader = chat.TurnReader()
    assert list(reader.feed(whole[:-1])) == turns[:-1]
    with pytest.raises(ValueError):
        reader.close()


def test_a_wrong_mask_shows(spark):
    rows = [(1, 1, "user", "ask"), (1, 2, "assistant", "yes <|im_end|> no"), (1, 3, "assistant", "more")]
    done = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    right = chat.digest(done).first()
    assert (right.loss_chars, right.loss_sha256) == (21, hashlib.sha256("yes <|im_end|> nomore".encode()).hexdigest())
    for wrong in ("loss_start + 1 as loss_start, loss_end", "loss_start, loss_end - 1 as loss_end", "0 as loss_start, length(piece) as loss_end"):
        got = chat.digest(done.selectExpr("conv_id", "turn", "piece", *wrong.split(", ", 1) if "length" not in wrong else ["0L as loss_start", "length(piece) as loss_end"])).first()
        assert (got.loss_chars, got.loss_sha256) != (right.loss_chars, right.loss_sha256)


def test_chat_digest(spark):
    rows = [(1, 2, "assistant", "yes <|im_end|>"), (1, 1, "user", None), (None, 1, "assistant", "é"), (2, None, None, "x"), (2, None, None, "x"), (3, 1, "assistant", "w" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as piece", "2 as loss_start")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256) == (2, sha("user\n\nassistant\nyes <|im_end|>\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (14, sha("yes <|im_end|>"))
    assert (got[None].n_turns, got[None].loss_chars) == (1, 1)
    assert (got[2].n_turns, got[2].loss_sha256) == (2, sha(""))
    assert got[3].formatted_chars == 300_000 + len("<|im_start|>assistant\n<|im_end|>\n")
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# --- WARC --------------------------------------------------------------------------------

def test_keys_and_records():
    assert warc.reversed_host("https://WWW.Example.com:8080/a/b?c=1#d") == "com,example,www)/a/b?c=1"
    assert warc.reversed_host(None) == ")/" and warc.reversed_host("http://[bad") == "http://[bad"
    body = "é\r\n\r\nWARC/1.1".encode()
    r = warc.parse_record(warc.record(7, 'http://x/"\n', "response", None, body, warc.payload_digest(body)))
    assert (r["page_id"], r["url"], r["payload"], r["payload_bytes"]) == (7, 'http://x/"\n', body, len(body))
    with pytest.raises(ValueError):
        warc.parse_record(warc.record(7, "u", "response", None, body, warc.payload_digest(b"")))


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, f"http://h{i % 3}.org/p{i % 5}", f"<p>{i % 7}</p>") for i in range(40)] + [(100, None, None), (101, "", ""), (None, "http://h0.org/p0", "<p>0</p>"), (102, "http://big/", "x" * 500_000)]
    rows += [(0, "http://h0.org/p0", "<p>0</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as first", "3 as key").repartition(3)
    folder = f"file://{tmp_path}/w"
    captures = warc.cut(warc.write_archives(df, folder))
    parts = warc.write_index(captures, folder)
    found = warc.lookup(captures.select("key"), parts, folder)
    got = warc.read_records(found, folder).collect()
    assert len(got) == len(rows)
    lowest = {}
    for i, _, h in rows:
        if i is not None:
            lowest[h or ""] = min(i, lowest.get(h or "", i))
    for r, (i, u, h) in zip(sorted(got, key=lambda r: (str(r.page_id), r.payload_digest)), sorted(rows, key=lambda x: (str(x[0]), warc.payload_digest((x[2] or "").encode())))):
        body = (h or "").encode()
        assert (r.page_id, r.url, r.payload_bytes, r.payload_digest) == (i, u or "", len(body), warc.payload_digest(body))
        assert (r.record_type, r.refers_to) == (("response", None) if lowest[h or ""] == i else ("revisit", lowest[h or ""]))
    missing = spark.createDataFrame([("org,none)/\x1f1",)], "key string")
    assert warc.lookup(missing, parts, folder).count() == 0
    nothing = warc.write_archives(df.limit(0), f"{folder}-none")
    assert warc.write_index(warc.cut(nothing), f"{folder}-none") == []


def test_a_second_attempt_writes_the_same_bytes(spark, tmp_path):
    r = random.Random(1)
    rows = [(i % 30, f"http://h{i % 4}.org/", f"<p>{i % 6}</p>") for i in range(60)]
    files = []
    for k in range(3):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        lines = warc.write_archives(df, f"file://{tmp_path}/{k}").collect()
        files.append((sorted(map(tuple, lines)), (tmp_path / str(k) / "archive" / "part-00000.warc.gz").read_bytes()))
    assert files[0] == files[1] == files[2]


TWO = "<p>It rained on the hills for nine days.</p><p>Then the sun came out and the river fell.</p>"


@pytest.mark.parametrize("name", "message feedback teaser newsletter modal links news-message warning-story banner-story overlay-text tooltip-article sponsor-report author-text share-story subscribe-article".split())
@pytest.mark.parametrize("holder", ["main", "div", "article"])
def test_an_article_counts_whatever_its_wrapper_is_called(name, holder):
    page = f'<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><{holder}><div class="{name}">{TWO}</div></{holder}><footer><p>All rights reserved</p></footer></body></html>'
    assert extract.main_text(page) == "It rained on the hills for nine days.\n\nThen the sun came out and the river fell."


@pytest.mark.parametrize("title", ["Discussion", "Comments", "Tags"])
def test_a_heading_alone_does_not_end_an_article(title):
    page = f"<article><h1>The mill</h1>{TWO * 3}<section><h2>{title}</h2><p>We owe thanks to the mill and its crates.</p></section></article>"
    assert "thanks to the mill" in extract.main_text(page)
    named = page.replace("<section>", '<section class="comments">')
    assert "thanks to the mill" not in extract.main_text(named)
    outside = f'<article><h1>The mill</h1>{TWO * 3}</article><section><h2>Comments</h2><p>We owe thanks to the mill.</p></section>'
    assert "thanks" not in extract.main_text(outside)


def test_small_parts_with_such_names_stay_out():
    for name in ("newsletter", "related", "share", "author", "comments", "message"):
        page = f'<main><h1>The mill</h1>{TWO * 4}<div class="{name}"><p>Some words of another kind.</p></div></main>'
        assert "another kind" not in extract.main_text(page)
