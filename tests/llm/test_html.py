from __future__ import annotations

import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from citetrust.llm.html_text import content, extract, main_text

LONG = "A paragraph of an article goes on for a while, so that there is a lot of text to each tag."
PARTS = """
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header><h1>The site</h1><p>Words of the site's header.</p></header>
<div class="ad">Buy this now, it is very cheap and it is very good, and you need it.</div>
<div id="cookie-banner"><p>This notice says that there are cookies, and more of them than you think.</p></div>
<aside><p>Text on the side that is long enough to look like text of an article, but is none.</p></aside>
<form action="/go"><label>Your name</label><input><button>Send</button></form>
<section class="comments"><h3>2 comments</h3><article class="comment"><p>I think so too, and I say it at some length here.</p></article></section>
<script>var x = "<p>no text</p>";</script><style>p { color: red }</style><!-- <p>hidden</p> -->
<p hidden>not shown</p><div style="display: none">nor this</div>
<footer>&copy; the owner, who writes a line that is not short at all, down here.</footer>
"""


def page(body: str, attributes: str = "") -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title</title></head><body {attributes}>{body}</body></html>'


def test_article_without_its_surroundings():
    inner = f"<header><h1>Big &amp; small</h1></header><p>{LONG}<p>Of.</p><p>a<b>b</b>c<br>d&nbsp;&#233;\n e</p><ul><li>one<li>two</ul>{PARTS}"
    want = f"Big & small\n{LONG}\nOf.\nabc d é e\none\ntwo"
    assert main_text(page(f"{PARTS}<article>{inner.replace('<header><h1>The site', '<header class=footer><h1>The site')}</article>{PARTS}")) == want
    assert main_text(page(f'<main class="with-sidebar">{inner.split("<nav>")[0]}</main>{PARTS}', 'class="has-sidebar"')) == want


def test_pages_without_an_article_element():
    body = f"<h1>Big</h1><p>{LONG}</p><p>Short.</p><p>{LONG} <a href=x>With a link.</a></p>"
    want = f"Big\n{LONG}\nShort.\n{LONG} With a link."
    menu = "<ul><li><a href=a>Home</a><li><a href=b>News and more</a></ul>"
    assert main_text(page(f'<div class="wrap">{menu}<div class="post">{body}</div>{PARTS}</div>')) == want
    assert main_text(page(f"{menu}{body}<hr><p><a href=x>Imprint</a></p>")) == want
    assert main_text(page(f"<div>{menu}</div><div><h1>Big</h1><div><div>{body[12:]}</div></div></div>")) == want


def test_the_largest_article_wins():
    teaser = "<article><h2>Another</h2><p>Read on.</p></article>"
    assert main_text(page(f"{teaser}<article><h1>Big</h1><p>{LONG}</p><p>{LONG}</p></article>{teaser}")) == f"Big\n{LONG}\n{LONG}"


def test_broken_markup():
    assert main_text("<![if foo]>x<!bad><p>a&#0;b<script>var a = '<p>no</p>'") == "x\na�b"
    assert main_text("<html><head><title>T<body><p>Hi there</p>") == "Hi there"
    assert main_text("<article>a < b <p>c &lt; d<a href='x") == "a < b\nc < d"
    assert main_text("<p>before</p><!-- never closed <p>after</p>") == "before"
    assert main_text("") == main_text("<p></p>") == main_text("<nav>only</nav>") == ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div class=ad> </div> <article> </article> text <!-- --> <![CDATA[ ]]> <! <?x &amp &#x <script> </script> <li> <td> </b> <b> <a\xa0href=' > < \0 <h1> <title> <body> <table> <main>".split(" ")), max_size=25))
def test_any_markup_is_taken(pieces):
    assert "<article>" not in main_text("".join(pieces))


def test_ratios_are_clustered_after_smoothing():
    ratios = np.array([0, 0, 0, 0, 0, 0, 90, 80, 2, 95, 0, 0, 0, 0, 0, 0], float)
    assert content(ratios)[6:10].all()
    assert not content(ratios)[[0, 1, 2, 14, 15]].any()
    assert content(np.array([5.0])).all() and content(np.array([3.0, 3.0])).all()


def test_given_pages(spark):
    """Their articles are headings and paragraphs, which a pattern finds as well."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")

    def plain(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = [re.sub(r"<[^>]*>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", inner)]
        return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)

    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect())
    assert sorted(map(tuple, extract(pages).collect())) == want


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", f"<p>{LONG}</p>", "x"), (2, "u", f"<p>{LONG}</p>", "x"), (3, "u", "<p>wörd</p>" * 50000, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r.page_id, r.url, r.n_chars) for r in extract(pages).collect()}
    assert got == {(1, None, 0), (None, "u", 0), (2, "u", len(LONG)), (3, "u", 5 * 50000 - 1)}
    assert extract(pages).count() == 5 and extract(pages.where("false")).count() == 0
