from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import html

DDL = "page_id long, url string, html string"


def _text(page):
    return " ".join(t for k, t in html.blocks(page) if k == html.ARTICLE)


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset=utf-8><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad <article>x</article> --><div class="ad">Buy</div><div id=cookie-notice>Cookies</div>
<article class="post"><h1>Title &lt;1&gt;</h1><p><b>First&nbsp;bold<i>er</i> text<br>line
  two<p>Second &copy; 5 < 6 &amp;&amp; 7 > 6 <script>if (a < b) {}</script>end</p><div class="share">Share</div><form><input name=q>Search</form>
<aside>Side</aside><ul><li>One<li>Two</ul><div role="navigation">Pages</div><p hidden>never</p><p style="display: none">never</p><table><tr><td>c1<td>c2</table>
<div id="comments"><article>Reader says</article></div></article><article class="comment">Reader</article><aside><article>Other</article></aside><footer>&copy; host</footer></body></html>"""


def test_article_without_everything_else():
    assert _text(PAGE) == "Title <1> First\xa0bolder text line two Second © 5 < 6 && 7 > 6 end One Two c1 c2"


@pytest.mark.parametrize(("page", "want"), [
    ("", ""), ("<article>", ""), ("<article>a", "a"), ("<article>a</article", "a"), ("<article><p>a<b>c</p><p>d</b>e</article>f", "ac de"),
    ("<ARTICLE>x &am &amp y &#65;&#x42;</ARTICLE>", "x &am & y AB"), ("<article>a <3 b <</article>", "a <3 b <"), ("<article title='a>b'>t</article>", "t"),
    ("<article><script>never ends</article>", ""), ("<main>m<nav>n</nav></main>", "m"), ("<div class=ad><p>open ad</p><article>t</article>", ""),
    ("<article>one<textarea>no</textarea> two<img alt='x'/>three</article>", "one twothree"),
])
def test_broken_pages(page, want):
    assert _text(page) == want


def test_unbalanced_quotes_take_linear_time():
    for n in (20_000, 20_001):
        assert html.blocks("<a \"" * n) == html.blocks("<a b=\"" * n) == html.blocks("<!-- " * n) == []
    assert html.blocks("<article>t</article><a title='it's'>u")[0] == (html.ARTICLE, "t")


def test_suffix_order_equals_sorting():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 200):
        tokens = rng.integers(0, 3, n)
        order, rank = html.suffix_order(tokens, 8)
        suffixes = [tuple(tokens[i:i + 8]) for i in range(n)]
        assert [suffixes[i] for i in order] == sorted(suffixes)
        assert all((rank[i] == rank[j]) == (suffixes[i] == suffixes[j]) for i in range(n) for j in range(n))


def _loose_pages():
    rng = random.Random(11)
    common = ["welcome to the site of our little town and region", "all rights reserved by the owners of this site forever", "Home", "Contact"]
    rows = []
    for i in range(60):
        own = " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
        mixed = f"own{i} text before {common[1]} and after it {i}"
        parts = [common[0], common[2], own, mixed, common[3], "short"]
        rows.append((i, f"http://{'hot' if i % 3 else 'b'}.example.com/{i}", "<body>" + "".join(f"<p>{p}</p>" for p in parts) + "<footer>" + common[1] + "</footer></body>"))
    return [*rows, (60, "http://alone.example.com/", rows[0][2]), (61, None, "<p>no host here</p>"), (61, None, "<p>no host here</p>"), (62, "http://n.example.com", None), (None, "http://n.example.com", "")]


def _plain(rows, run):
    """Runs on two distinct pages of a host, by comparing sets of all runs."""
    def host(url):
        return (url or "").split("//")[-1].split("/")[0]

    def runs(w):
        return [(i, tuple(w[i:i + run])) for i in range(len(w) - run + 1)] or [(0, tuple(w))]

    where = {}
    for page, url, text in rows:
        for _, t in html.blocks(text or ""):
            for _, r in runs(t.split(" ")):
                where.setdefault((host(url), r), set()).add(page)
    out = []
    for page, url, text in rows:
        kept = []
        for k, t in html.blocks(text or ""):
            if k == html.LOOSE:
                w = t.split(" ")
                gone = {j for i, r in runs(w) if len(where[host(url), r]) > 1 for j in range(i, i + len(r))}
                kept += [x for j, x in enumerate(w) if j not in gone]
        out.append((page, " ".join(kept)))
    return out


@pytest.mark.parametrize(("run", "chunk"), [(8, 2000), (4, 7)])
def test_host_boilerplate_equals_plain_version(spark, run, chunk):
    rows = _loose_pages()
    out = html.main_text(spark.createDataFrame(rows, DDL).withColumn("text", F.lit("x")), run, chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["page_id"], r["text"]) for r in out), key=key) == sorted(_plain(rows, run), key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_articles_that_pages_share_stay(spark):
    page = "<nav>Menu</nav><article><p>the same long article text on two pages of a host</p></article>"
    rows = [(i, "http://h.example.com", page) for i in (1, 2, 2)] + [(3, "http://h.example.com", "<p>the same long article text on two pages of a host again</p>")]
    out = html.main_text(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r["page_id"], r["text"]) for r in out)[:3] == [(i, "the same long article text on two pages of a host") for i in (1, 2, 2)]
    assert html.main_text(spark.createDataFrame([], DDL)).count() == 0


class _Events(HTMLParser):
    """The article's text by the standard library's parser, for pages of the tables' form."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_given_pages_equal_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    for r in pages.collect():
        parser = _Events()
        parser.feed(r["html"])
        parser.close()
        assert out[r["page_id"]] == " ".join("".join(parser.parts).split())


def test_a_teaser_is_not_the_article(spark):
    def body(i):
        return " ".join(f"word{i}x{k}" for k in range(30))

    shared = "Read more of our finest stories every day of the week, only on this very site."
    rows = [(i, f"http://h/{i}", f"<div>{shared}</div><article>Teaser {i}</article><div>{body(i)} Number {i}.</div><div>{shared}</div>") for i in range(3)]
    rows += [(9, "http://h/9", f"<div>By someone</div><article>{body(9)} In full, with <b>more</b> of it, ninth.</article><div>{shared}</div>")]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == f"{body(9)} In full, with more of it, ninth."
    # what other pages of the host have too goes, what is this page's own stays, in page order
    assert {i: out[i] for i in range(3)} == {i: f"Teaser {i} {body(i)} Number {i}." for i in range(3)}


def _notice_pages():
    rng = random.Random(5)
    notice = "Sign up for our free daily letter and get every story first"
    usual = "some passage of eight words that few have"

    def own(n):
        return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))

    def page(*blocks):
        return "<nav>Menu</nav><article><h1>In short</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"

    rows = []
    for i in range(40):
        rows.append((f"http://many/{i}", page(own(30), *([notice] if i % 4 else []), *([usual] if i % 3 == 0 else []), f"{notice} {i}", own(9))))
        rows.append((f"http://few/{i}", page(own(30), notice)) if i < 9 else (f"http://loose/{i}", page(own(30), notice) + f"<p>beside {own(3)}</p>"))
        rows.append((f"http://copies/{i}", rows[0][1]))
        rows.append((f"http://versions/{i}", page("an article of which each version has all words but the last", f"version {i}")))
    return [(i, *r) for i, r in enumerate(rows)] + [(999, "http://many/", None), (1000, "http://many/none", "<p>nothing</p>"), (0, *rows[0])]


def _plain_notices(rows, run):
    """The text of pages without loose blocks by counting, per host, the different articles that have each run."""
    having, articles = {}, {}
    read = [(p, url.split("/")[2], html.blocks(page or "")) for p, url, page in rows]
    for _, host, found in read:
        text = tuple(t for k, t in found if k == html.ARTICLE)
        if text:
            articles.setdefault(host, set()).add(text)
            for w in (t.split() for t in text):
                for i in range(len(w) - run + 1):
                    having.setdefault((host, tuple(w[i:i + run])), set()).add(text)

    def covered(host, w):
        there = set()
        for i in range(len(w) - run + 1):
            n = len(having[host, tuple(w[i:i + run])])
            if n >= html.COMMON and 2 * n > len(articles[host]):
                there |= set(range(i, i + run))
        return len(there) == len(w)

    out = []
    for p, host, found in read:
        if any(k == html.LOOSE for k, _ in found):
            continue
        text = [t for k, t in found if k == html.ARTICLE]
        kept = [t for t in text if not covered(host, t.split())]
        out.append((p, " ".join(text if 2 * sum(map(len, kept)) <= sum(map(len, text)) else kept)))
    return out


@pytest.mark.parametrize(("run", "chunk"), [(8, 2000), (8, 7), (4, 3)])
def test_articles_pass_through_the_arrays_of_their_host(spark, monkeypatch, run, chunk):
    monkeypatch.setattr(html, "SENT_RUNS", 0 if run == 4 else html.SENT_RUNS)
    rows = _notice_pages()
    out = html.main_text(spark.createDataFrame(rows, DDL), run, chunk).collect()
    notice = "Sign up for our free daily letter and get every story first"
    texts = sorted((r["page_id"], r["text"]) for r in out if "/loose/" not in r["url"] and "/none" not in r["url"])
    assert texts == sorted(_plain_notices(rows, run))
    of = {r["url"]: r["text"] for r in out}
    assert notice not in of["http://loose/20"] and " beside " not in of["http://loose/20"]
    assert all(of[f"http://few/{i}"].endswith(notice) for i in range(9))
    assert len({of[f"http://copies/{i}"] for i in range(40)}) == 1 and "In short" in of["http://copies/3"]
    assert all(of[f"http://versions/{i}"].endswith(f"all words but the last version {i}") for i in range(40))
    # a block with words of the page's own is no notice
    assert all(of[f"http://many/{i}"].count(notice) == 1 and of[f"http://many/{i}"].startswith("In short w") for i in range(40))


def test_class_names_are_read_whole():
    def kept(name):
        return bool([t for k, t in html.blocks(f"<article>a<div class='{name}'>b</div></article>") if t == "b" and k == html.ARTICLE])

    assert all(map(kept, ("share-price", "comment-worthy", "story", "ad-hoc", "price", "notice-period", "_", "-")))
    assert not any(map(kept, ("share", "site-header", "cookie_banner", "nav-main", "sidebar-left", "x comment", "comment-list", "ad")))


def test_unmatched_closers_take_linear_time():
    start = time.monotonic()
    assert html.blocks("<div>" * 100_000 + "</span></li>" * 100_000 + "x") == [(html.LOOSE, "x")]
    assert html.blocks("<i>" * 100_000 + "</b>" * 100_000 + "<p>y<p>z") == [(html.LOOSE, "y"), (html.LOOSE, "z")]
    assert time.monotonic() - start < 20
