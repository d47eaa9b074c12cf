"""Main text of web pages as the maximum-scoring run of tokens.

A page is read as a sequence of text and tag tokens. A word scores positive and a tag
negative, with weights learned from the labelled pages below. Elements have log odds, from
their tag name, their class, id or role words, and a heading that they begin with: an element
that was mostly seen around furniture (below ``FURNITURE``) is furniture, and the words inside
score negative. A name speaks against an element the less, the more of the text it holds
(``SHARE``), since what holds nearly all of an article's place is the article, whatever it is
called; and inside an article a heading alone does not make a part furniture. Inside an element that was mostly seen in articles words weigh more, so that
short blocks at the edges outweigh the tags between. One linear scan finds the run of tokens
with the largest sum. The result is the blocks of that run, without furniture inside it.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import table

#: Labelled pages: pieces of markup, 1 for the article and 0 for what stands around it.
LABELLED = [
    [
        (0, "<head><title>Site: a day out</title><style>p{}</style><script>go()</script></head>"),
        (0, '<header class="site-header"><a href="/">Home</a></header><nav class="main-menu"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul></nav>'),
        (0, '<div class="ad">Buy one now and save</div><div class="breadcrumbs"><a href="/">Home</a> <a href="/n">News</a></div>'),
        (1, "<article><h1>A day out by the river</h1><p>We set out early in the morning and walked along the bank until noon.</p><p>There was <b>no one</b> about, and the <a href='/w'>water</a> was low.</p><h2>After noon</h2><ul><li>bread and cheese</li><li>a little wine</li></ul><blockquote>It was the best of days</blockquote></article>"),
        (0, '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>'),
        (0, '<section class="comments" id="comments"><h3>Comments</h3><p>I liked this very much, thank you.</p><p>So did I, well done.</p></section>'),
        (0, '<footer class="site-footer"><p>Copyright the site</p><a href="/c">Contact</a></footer>'),
    ],
    [
        (0, "<head><title>How bread is made</title><noscript>Enable scripts</noscript></head>"),
        (0, '<div id="cookie-notice" class="banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>'),
        (0, '<div id="topbar"><ul class="nav menu"><li><a href="/x">Shop</a></li><li><a href="/y">About</a></li></ul></div><form class="search"><input name="q"><label>Search</label></form>'),
        (1, '<main id="content"><div class="post-content entry"><header><h1>How bread is made</h1></header><p>Flour, water and salt are mixed and left to stand for a night.</p><pre>mix; wait; bake</pre><p>In the morning the dough is <em>folded</em> and <strong>baked</strong>.<br>That is all there is to it.</p><table><tr><td>flour</td><td>500 g</td></tr></table><figure><figcaption>The loaf</figcaption></figure></div></main>'),
        (0, '<div class="related-posts widget"><h4>Related</h4><ul><li><a href="/k">Cakes</a></li></ul></div><div class="share social"><a href="/t">Share</a></div>'),
        (0, '<div class="newsletter subscribe"><p>Get our letter every week.</p><form><input><button>Sign up</button></form></div>'),
        (0, '<div class="comment-list discussion"><div class="comment reply"><p>My loaf was flat, what went wrong?</p></div></div><div id="footer" class="copyright legal"><p>All rights reserved.</p></div>'),
    ],
    [
        (0, '<div role="navigation" class="navbar"><a href="/1">Start</a><a href="/2">Map</a></div><div role="banner" class="masthead logo">The Daily</div>'),
        (0, '<div class="advert sponsored promo advertisement ads"><p>The best shoes in town at half the price.</p></div><div class="alert notice popup modal consent cookie gdpr"><p>Please agree to our terms.</p></div>'),
        (1, '<div class="article-body story text"><h1>Rain at last</h1><p class="lead intro">After nine dry weeks the rain came on Sunday night.</p><p>Farmers in the valley had given up on the harvest.</p><ol><li>first the wheat</li><li>then the maize</li></ol><dl><dt>rain</dt><dd>40 mm</dd></dl><section><h2>What next</h2><p>More is to come, it is said.</p></section></div>'),
        (0, '<div role="complementary" class="side rail recommended trending"><p>You may also like these.</p></div><div class="pagination pager tags meta toolbar"><a href="/p2">2</a></div>'),
        (0, '<div role="contentinfo" class="bottom foot"><small>Terms and privacy</small></div><div class="login signup skip"><a href="/l">Log in</a></div><svg><text>x</text></svg><iframe></iframe><select><option>en</option></select><textarea></textarea><template><p>no</p></template><dialog><p>Stay a while</p></dialog><menu><li>Copy</li></menu>'),
        (0, '<ul class="comments responses"><li class="comment"><p>We needed that rain.</p></li></ul><script>track()</script><style>b{}</style>'),
    ],
    [
        (0, '<div class="sidebar nav"><a href="/1">Up</a></div>'),
        (1, '<div id="page" class="site container wrapper"><div class="row"><div id="main" class="main main-content col"><div><div><h1>Two towns</h1><p>The towns lie on either side of the pass.</p><h3>The upper town</h3><div>It is the older one, and <span>built of stone</span>.</div><ul><li>a church</li><li>a mill</li></ul><a href="/m">a map</a></div></div></div></div></div>'),
        (0, '<div class="footer"><p>Made in the hills</p></div><div class="header top"><a href="/">Hills</a></div><div class="related author widget meta links"><a href="/2">Next</a></div>'),
        (0, '<div class="ad ads advert"><p>Wool</p></div><div class="cookie cookies banner"><p>Cookies</p></div><div class="nav menu"><a href="/3">Up</a></div><div class="comments comment replies"><p>Well said</p></div><div class="breadcrumb pagination"><a href="/4">4</a></div><div class="search login signup"><p>Find</p></div>'),
    ],
    [
        (0, '<div class="page-header site-header-wrapper"><a href="/">The post</a></div>'),
        (1, '<div class="single-post post entry story article content"><div class="article-header post-header entry-header story-header"><h1 class="article-title post-title entry-title">On foot</h1></div><div class="post-body entry-content article-content"><p>It is nine miles to the sea.</p><p>We walked them all in rain.</p></div></div>'),
        (0, '<div id="respond" class="comment-respond feedback replies"><form><p>Leave a reply</p></form></div><div class="author-box byline-box"><p>The writer lives here.</p></div><div class="teaser more-stories read-more recommendations"><p>More to read</p></div>'),
        (0, '<div class="disclaimer warning message overlay lightbox toast tooltip banner-ad sponsor"><p>Please note our terms.</p></div><div class="sitemap links copyright-notice breadcrumb crumbs pagination-links"><a href="/a">A</a></div>'),
    ],
    [
        (0, "<nav><a href='/'>Back</a></nav>"),
        (1, '<body><div class="main page-list posts-body"><section><h1>Nine winters</h1><h4>A letter</h4><div><p>Dear friend, the snow came early.</p></div><div><p>We have wood for nine weeks and bread for six.</p></div></section></div></body>'),
        (0, "<header><a href='/'>Letters</a></header><aside><p>Other letters</p></aside><footer><p>The archive</p></footer><form><input><button>Send</button></form><button>Print</button>"),
    ],
]
#: Labelled headings of parts of a page: 1 of an article, 0 of what stands around it.
LABELLED_HEADINGS = {
    0: [
        "Comments", "Comment", "Responses", "Replies", "Discussion", "Leave a comment", "Leave a reply", "Join the discussion", "Reader comments", "Related", "Related articles",
        "Related posts", "Related stories", "You may also like", "Read more", "Read next", "More stories", "Most read", "Most popular", "Recommended", "Advertisement", "Sponsored", "Share",
        "Share this", "Follow us", "Newsletter", "Subscribe", "Tags", "Kommentare", "Leserkommentare", "Verwandte Artikel", "Mehr zum Thema", "Anzeige", "Commentaires", "Sur le même sujet",
        "Articles liés", "Publicité", "Comentarios", "Artículos relacionados", "Te puede interesar", "Publicidad",
    ],
    1: ["A day out by the river", "After noon", "How bread is made", "Rain at last", "What next", "Two towns", "The upper town", "On foot", "Nine winters", "A letter"],
}

#: log odds below which an element is furniture
FURNITURE = -0.8
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a start tag ends an open element of the same group
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_RAW = "script|style|noscript|template|textarea|iframe|svg|title"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>{_RAW})(?=[\s/>])(?P<rawattr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
HOLDERS = frozenset(("article", "main"))
#: first and last words of names that only state something
STATING = frozenset("has no with without is".split())
STATES = frozenset("open closed enabled disabled on off active".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
#: tags of text blocks cost at most so much of a word, so that a word outweighs those of its block
OF_WORD = 0.4
#: tags inside an element that is mostly seen in articles cost so much of their weight
INSIDE = 0.1
#: what begins with a heading and is not an article as such
SECTIONS = frozenset("div section aside ul ol dl table form details fieldset center".split())
#: words of a heading that is looked up, at most
HEADING_WORDS = 4
#: how far names against an element are taken back where it holds all of the text around it
SHARE = 2.0
#: how much more a word weighs in an element with the best odds
LIFT = 2.0


def names(attr: str) -> list[list[str]]:
    """The class, id and role names of an element, each as its words."""
    if "=" not in attr:
        return []
    tokens = (t for m in ATTR.finditer(attr) for t in m[1].strip("\"'").split())
    return [w for t in tokens if (w := [x.lower() for x in WORD.findall(t)])]


def heading(text: str) -> str:
    """A heading as it is looked up: its words in lower case, without numbers and signs."""
    return "#" + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def cues(tag: str, attr: str, inside: bool) -> list[str]:
    """What an element shows of its use: its names, those of several words as a whole, or
    without names its tag, marked where it stands in an article."""
    return ["." + "-".join(words) for words in names(attr)] or [f"{tag}+" if inside else tag]


class Weights:
    """Weights from the labelled pages."""

    def __init__(self):
        seen = [Counter(), Counter()]
        size = [Counter(), Counter()]
        for page in LABELLED:
            for label, piece in page:
                inside = False
                last = depth = 0
                for m in TOKEN.finditer(piece):
                    size[label]["word"] += len(piece[last : m.start()].split())
                    last = m.end()
                    tag = (m["tag"] or m["raw"] or "").lower()
                    if not tag:
                        continue
                    size[label]["tag"] += 1
                    size[label][f"tag {tag}"] += 1
                    if m["end"]:
                        depth -= 1
                        continue
                    if label or not depth:  # what is inside furniture owes its label to the outermost element
                        seen[label].update(set(cues(tag, m["attr"] or m["rawattr"] or "", inside)))
                    inside |= tag in HOLDERS
                    depth += m["tag"] is not None and tag not in VOID
        for label, titles in LABELLED_HEADINGS.items():
            seen[label].update(map(heading, titles))
        self.odds = {c: math.log((seen[1][c] + 0.25) / (seen[0][c] + 0.25)) for c in {*seen[0], *seen[1]}}
        total = [s["word"] + s["tag"] for s in size]
        share = lambda k, n: (size[k][n] + 1) / total[k]
        self.best = max(self.odds.values())
        self.ends = [(c[1:], o) for c, o in self.odds.items() if c[0] == "." and "-" not in c and len(c) > 3 and o < FURNITURE]
        self.word = math.log(share(1, "word") / share(0, "word"))
        self.any_tag = min(-0.1, math.log(share(1, "tag") / share(0, "tag")))
        names = {k[4:] for s in size for k in s if k.startswith("tag ")}
        self.tag = {n: max(-OF_WORD * self.word if n in TEXT else -3.0, min(-0.05, math.log(share(1, f"tag {n}") / share(0, f"tag {n}")) + self.any_tag)) for n in names}

    def _word(self, word: str) -> float:
        """Odds of one word of a name; an unknown one counts as the furniture it ends with."""
        known = self.odds.get(f".{word}")
        return known if known is not None else min((o for w, o in self.ends if word.endswith(w)), default=0.0)

    def element(self, tag: str, inside: bool) -> float:
        """Log odds of an element by its tag, where they are against it."""
        return min(0.0, self.odds.get(f"{tag}+" if inside and f"{tag}+" in self.odds else tag, 0.0))

    def named(self, attr: str) -> float:
        """Log odds of an element by each of its names. A name that was seen as a whole counts
        as such; else its most telling furniture word counts, if it has one (sidebar-content),
        or its best word. Names that only state something (has-sidebar, comments-open) do not
        count."""
        out = 0.0
        for words in names(attr):
            if words[0] in STATING or (len(words) > 1 and words[-1] in STATES):
                continue
            whole = self.odds.get("." + "-".join(words))
            if whole is None:
                each = [self._word(w) for w in words]
                whole = min(each) if min(each) < 0 else max(each)
            out += whole
        return out


@cache
def weights() -> Weights:
    return Weights()


class Page:
    """A page as tokens and elements. Elements are numbered as they begin, so parents come
    before children; 0 stands around all of them."""

    def __init__(self, page: str, w: Weights):
        self.w = w
        self.parent, self.name, self.odds, self.named = [0], [""], [0.0], [0.0]
        #: block of the first text in an element, if it is its own or that of a child
        self.head: list[int] = [-1]
        #: score as a tag, text, block, element, whether inside a link
        self.items: list[tuple[float, str, int, int, bool]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        w, items, parent, name = self.w, self.items, self.parent, self.name
        stack: list[int] = []
        holds: list[bool] = []  # of open elements, whether inside an article
        blocks: list[int] = []  # places of open block elements in the stack
        fresh: list[int] = []  # elements without text so far
        open_tags: Counter = Counter()
        block = last = 0

        def text(raw: str) -> None:
            if not raw:
                return
            at = stack[-1] if stack else 0
            if raw.isspace():
                items.append((0.0, " ", block, at, False))
                return
            for e in fresh:
                if e == at or parent[at] == e:
                    self.head[e] = block
            fresh.clear()
            items.append((0.0, raw, block, at, any(name[e] == "a" for e in stack[-4:])))

        def close(at: int) -> None:
            nonlocal block
            if blocks and blocks[-1] >= at:
                block += 1
                while blocks and blocks[-1] >= at:
                    blocks.pop()
            open_tags.subtract(name[e] for e in stack[at:])
            del stack[at:], holds[at:]

        for m in TOKEN.finditer(page):
            text(page[last : m.start()])
            last = m.end()
            at = stack[-1] if stack else 0
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    items.append((w.tag.get(m["raw"].lower(), w.any_tag), "", block, at, False))
                continue
            tag = tag.lower()
            items.append((w.tag.get(tag, w.any_tag), " " if tag == "br" else "", block, at, False))
            if tag in BLOCK:
                block += 1
            if m["end"]:
                if open_tags[tag] > 0:
                    i = len(stack) - 1
                    while name[stack[i]] != tag:
                        i -= 1
                    close(i)
                continue
            if blocks and name[stack[blocks[-1]]] in CLOSES.get(tag, ("p",) if tag in BLOCK else ()):
                close(blocks[-1])
            if tag in VOID or m["attr"].endswith("/"):
                continue
            inside = bool(holds) and holds[-1]
            if tag in BLOCK:
                blocks.append(len(stack))
            parent.append(stack[-1] if stack else 0)
            stack.append(len(name))
            fresh.append(len(name))
            name.append(tag)
            whole = tag in ("html", "body")
            self.odds.append(0.0 if whole else w.element(tag, inside))
            self.named.append(0.0 if whole else w.named(m["attr"]))
            self.head.append(-1)
            holds.append(inside or tag in HOLDERS)
            open_tags[tag] += 1
        text(page[last:])

    def furniture(self) -> tuple[list[bool], list[float]]:
        """Of every element, whether it is or stands in furniture, and the best odds of those
        around it that are for it."""
        n = len(self.name)
        words = [0] * n
        heads: dict[int, list[str]] = {b: [] for b in self.head if b >= 0}
        for _, t, b, e, _ in self.items:
            if t:
                words[e] += len(t.split())
                if b in heads:
                    heads[b].append(t)
        # words of an element without those in parts that are furniture by their tags
        own, holds = [0] * n, [False] * n
        for e in range(n - 1, 0, -1):
            own[e] = 0 if self.odds[e] < FURNITURE else own[e] + words[e]
            own[self.parent[e]] += own[e]
            holds[e] |= self.name[e] in HOLDERS and own[e] > 0
            holds[self.parent[e]] |= holds[e]
        own[0] += words[0]
        for e in range(n - 1, 0, -1):
            words[self.parent[e]] += words[e]
        out, good = [False] * n, [0.0] * n
        around, article = [0] * n, [False] * n  # the article, main or page that it stands in
        for e in range(1, n):
            up = self.parent[e]
            around[e] = up if self.name[up] in HOLDERS else around[up]
            article[e] = article[up] or self.name[up] == "article"
            named = self.named[e]
            # where there is an article or main, other places are not taken for it
            if named < 0 and (around[e] or holds[e] or not holds[0]):
                named = min(0.0, named + SHARE * own[e] / max(1, own[around[e]]))
            odds = self.odds[e] + named
            # a heading speaks of a part of the page, not of most of it
            if self.name[e] in SECTIONS and self.head[e] >= 0 and 2 * words[e] < words[0] and (odds < 0 or not article[e]):
                title = html_lib.unescape("".join(heads[self.head[e]]))
                if len(title.split()) <= HEADING_WORDS:
                    odds += min(0.0, self.w.odds.get(heading(title), 0.0))
            out[e] = out[up] or odds < FURNITURE
            good[e] = max(good[up], odds, self.w.best if self.name[e] in HOLDERS and not out[e] else 0.0)
        return out, good


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first of the contiguous parts with the largest sum above zero, as a half-open
    range; empty where no score is positive. One scan."""
    best = total = 0.0
    lo = hi = start = 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, lo, hi = total, start, i + 1
    return lo, hi


def main_text(page: str | None) -> str:
    """The article's blocks, joined by two line feeds; empty where there is none."""
    w = weights()
    p = Page(page or "", w)
    out, good = p.furniture()

    def score(tag: float, t: str, e: int, linked: bool) -> float:
        n = len(t.split())
        if not n:
            return tag * (INSIDE if good[e] > 0 else 1.0)
        lift = 1 + LIFT * min(1.0, good[e] / w.best)
        if out[e]:
            # what is known to be furniture inside an article does not end it
            return 0.0 if good[e] > 0 else -n * w.word
        return n * w.word * lift * (0.3 if linked else 1.0)

    lo, hi = best_run([score(tag, t, e, linked) for tag, t, _, e, linked in p.items])
    # a block that the run cuts is taken whole
    taken = {b for _, t, b, e, _ in p.items[lo:hi] if t and not t.isspace() and not out[e]}
    blocks: dict[int, list[str]] = {}
    for _, t, b, e, _ in p.items:
        if t and b in taken and not out[e]:
            blocks.setdefault(b, []).append(t)
    done = (" ".join(html_lib.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
    return "\n\n".join(x for x in done if x)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages, then text and n_chars; a scan without a shuffle. Null html is
    an empty page, whose text is empty. Of runs with equal sums the first counts. Repeated
    rows have equal texts. A very long page is read in time and memory in proportion to it,
    however deep it is or many of its tags are open. An empty table gives an empty table.
    Columns named text or n_chars are replaced."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(x) for x in series], dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", of(html)).withColumn("n_chars", F.char_length("text").cast("long"))


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
