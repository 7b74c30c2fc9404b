"""HTML extraction: what goes, what stays, and what a host's pages agree on."""

import os
import re

import duckdb
import pytest

from servicenight.llm.html_extract import Page, extract, page_report, votes, winning_paths

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"

FULL = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var x="</p><p>no";</script></head>
<body class="has-sidebar"><!-- no <p>no</p> --><header class="site"><h1>Site</h1><p>Slogan no</p></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use no cookies</div>
<div id="content"><div class="breadcrumbs"><a>Up</a></div>
<article><header><h1>A   title &amp; more</h1></header><p>First <b>bold</b>ly,<br>then&nbsp;&#8212; &lt;tag&gt;
 on.</p><div class="ad-box">Buy no</div><p>Second <a href="x">link</a> text<ul><li>one<li>two</ul>
<aside>Aside no</aside><form><label>Mail no</label><input value="no"></form><blockquote>Quoted</blockquote>
<section class="comments"><p>A reader says no</p></section><script>no()</script><p hidden>hidden no</p></article>
<div class="sidebar"><p>Side no</p></div></div><footer>&copy; no</footer></body></html>"""


def test_what_is_not_the_article_goes():
    assert Page(FULL).main_text(None) == "A title & more First boldly, then — <tag> on. Second link text one two Quoted"


@pytest.mark.parametrize("source, wanted", [
    ("", ""), ("plain text", "plain text"), ("<p>open", "open"), ("<p>a<p>b</p></div>c", "a b c"), ("<", "<"), ("a < b", "a < b"),
    ("<p>x<script>y", "x"), ("<p>x<!-- y", "x"), ("<p>x<a href='>y", "xy"), ("<td>1<td>2", "1 2"), ("<p>&notanentity; &#x41;&#0;</p>", "¬anentity; A�"),
    ("<div>" * 300 + "deep" + "</div>" * 300, "deep"), ("<p>" + "word " * 50_000, ("word " * 50_000).strip()), ("<i>a</b>b</i>c", "abc")])
def test_broken_and_odd_pages(source, wanted):
    assert Page(source).main_text(None) == wanted


def page(body, extra=""):
    return f"<html><body><nav><a>menu</a></nav>{body}{extra}</body></html>"


def test_a_host_agrees_on_its_path(spark):
    """A short article is found by the path of its host's other pages, though a teaser list has more text."""
    story = lambda n, words: page(f'<div class="box teasers"><p>{"teaser words " * 4}</p></div><div class="body-{n}"><p>{words}</p></div>')
    rows = [(n, "http://news.example/a", story(n, "real story words " * 30)) for n in range(9)]
    rows += [(9, "http://news.example/b", story(9, "short")), (10, "http://other.example/", story(10, "short")),
             (11, "http://news.example/c", page("<div class='plain'><p>no such container</p></div>")), (12, None, story(12, "words " * 50)),
             (13, "http://NEWS.example:80/d", story(13, "upper")), (14, "no url", None), (15, "http://news.example/e", "")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    won = {r.host: r.winner for r in winning_paths(votes(pages)).collect()}
    assert won["news.example"] == ">html>body>div.body-#" and won[""].endswith("div.body-#")
    got = {r.page_id: (r.text, r.n_chars) for r in page_report(pages).collect()}
    assert got[9] == ("short", 5) and got[13] == ("upper", 5) and got[11][0] == "no such container"
    assert got[10][0].startswith("teaser") and got[14] == ("", 0) and got[15] == ("", 0)


def test_clashing_columns_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", page("<p>text here</p>"), "w", "h", "t", 3)],
                                  SCHEMA + ", winner string, html_read string, text string, n_chars int")
    [row] = extract(pages, pages.columns).collect()
    assert (row.winner, row.html_read, row.text, row.n_chars) == ("w", "h", "text here", 9)
    assert page_report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables absent")
def test_given_pages(spark):
    """The given pages mark their article, so a plain cut between its tags is the expectation."""
    import html
    wanted = {}
    for page_id, source in duckdb.sql(f"SELECT page_id, html FROM '{SF_DIR}/pages.parquet'").fetchall():
        body = re.search(r"(?s)<article>(.*?)</article>", source)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks]
        wanted[page_id] = " ".join(t for t in texts if t)
    got = {r.page_id: r.text for r in page_report(spark.read.parquet(f"{SF_DIR}/pages.parquet")).collect()}
    assert got == wanted


BODY = "<p>" + "The body of the story goes on. " * 20 + "</p>"
TEXT = ("The body of the story goes on. " * 20).strip()
TEASERS = '<div class="teasers"><p><a href="/1">One more story to read</a> <a href="/2">And another one</a></p></div>'


@pytest.mark.parametrize("body, wanted", [
    (f'<article><h1>T</h1><p>lead</p><div class="entry-content">{BODY}</div></article>', f"T lead {TEXT}"),
    (f'<article><h1>T</h1><div class="a">{BODY}</div><div class="b"><p>second part</p></div></article>', f"T {TEXT} second part"),
    (f'<main><h1>T</h1><p>lead</p><div class="text">{BODY}</div>{TEASERS}</main>', f"T lead {TEXT}"),
    (f'<main><h1>T</h1><article>{BODY}</article><article><p>Other story</p></article></main>', f"T {TEXT} Other story"),
    (f'<div class="page"><h1>T</h1><p>lead</p><div class="text">{BODY}</div>{TEASERS}</div>', f"T lead {TEXT}"),
    (f'<div class="page"><div class="head"><h1>T</h1></div><div class="text">{BODY}</div><div class="end"><p>last</p></div></div>', f"T {TEXT} last"),
    (f'<div><section class="x">{BODY}</section><section class="y"><p>last part</p></section></div>', f"{TEXT} last part"),
    (f'<h1>T</h1><p>lead</p><div class="text">{BODY}</div>{TEASERS}', f"T lead {TEXT}"),
    (f'<div class="wrap"><div class="text">{BODY}</div><div class="box"><p>A box of the layout</p></div></div>', TEXT),
    (f'<h1>Site</h1><article><h1>T</h1>{BODY}</article>', f"T {TEXT}")])
def test_a_container_is_widened_to_its_article(body, wanted):
    assert Page(page(body)).main_text(None) == wanted
    path = max(Page(page(body)).scores().items(), key=lambda s: s[1])[0]
    assert Page(page(body)).main_text(Page(page(body)).path[path]) == wanted


def test_a_path_that_holds_a_caption_is_left(spark):
    """The host's path is on the page, but the article stands elsewhere."""
    rows = [(n, "http://a.example/", page(f'<div class="story">{BODY}</div>')) for n in range(5)]
    rows += [(5, "http://a.example/x", page(f'<div class="story"><p>A caption</p></div><div class="feature">{BODY}</div>')),
             (6, "http://a.example/y", page(f'<div class="story"><p>{"A short story. " * 10}</p></div><article>{BODY}</article>'))]
    got = {r.page_id: r.text for r in page_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got.values()) == {TEXT}


@pytest.mark.parametrize("body, wanted", [
    *[(f'<div class="wrap {name}"><article><h1>T</h1>{BODY}</article></div>', f"T {TEXT}") for name in
      ("has-sidebar", "no-sidebar", "menu-open", "comments-open", "left-sidebar", "sidebar", "widget")],
    (f'<div class="content-sidebar"><main><h1>T</h1>{BODY}</main><div class="sidebar"><p>Side</p></div></div>', f"T {TEXT}"),
    (f'<div class="sidebar-right"><h1>T</h1>{BODY}</div><div class="footer">Imprint</div>', f"T {TEXT}"),
    (f'<form id="page"><input><div class="x"><h1>T</h1>{BODY}</div><nav><a>Menu</a></nav></form>', f"T {TEXT}"),
    (f'<form><div class="comments"><article>{BODY}</article></div><article><h1>T</h1><p>Short</p></article></form>', "T Short"),
    (f'<article><h2 id="search">Search</h2>{BODY}<section id="social-history"><p>History</p></section><p class="notice-period">A month</p></article>',
     f"Search {TEXT} History A month"),
    (f'<article>{BODY}<p>Of <a title="the hidden figures">figures</a><a hidden>no</a><a hidden="">no</a></p><p HIDDEN>no</p></article>', f"{TEXT} Of figures"),
    (f'<article>{BODY}</article><div class="related"><article><p>Other</p></article></div>', TEXT),
    *[(f'<article>{BODY}<div class="{name}"><p>no</p></div></article>', TEXT) for name in
      ("ad", "ad-box", "google-ads", "cookie-notice", "comment-list", "post-share", "l-sidebar__inner", "Related-Posts", "widget-2", "is-hidden", "visually-hidden", "x nav")],
    (f'<div class="story">{BODY}</div><div class="comments"><p>{"A reader says a lot. " * 90}</p></div>', TEXT)])
def test_names_drop_what_they_name(body, wanted):
    assert Page(page(body)).main_text(None) == wanted
