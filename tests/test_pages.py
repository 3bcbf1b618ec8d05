from __future__ import annotations

import time
from html import unescape
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from driftwatch.functions import html as h
from driftwatch.operators import pages as pg

PAGE = """<!DOCTYPE html><html><head><title> Test &amp; Page </title><meta content='about us' name="description">
<style>p{}</style></head><body class="home page"><!-- note --><script>var a = "</p>";</script>
<h1 id="top">Main Heading</h1><p>First paragraph with &quot;quotes&quot;<br>and a break</p>
<div style="display: none"><p>secret words here</p></div><p aria-hidden="true">gone too and away</p>
<ul><li>one<li>two <b>bold</ul>
<form ACTION="/go" method=POST><input name=q required><textarea name="t"></textarea><select id=s></select></form>
<a href="../up.html" title="T">Up link</a><a href="#x">skip</a><a href="https://other.example/">Other site</a><img src="i.png" alt="pic">
<footer>Footer text that is long</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([(1, "https://site.example/a/b/c.html", PAGE)], "page_id long, url string, html string")
    return pg.extract(df).first()


def test_title_and_description(page):
    assert page.title == "Test & Page" and page.meta_description == "about us"


def test_blocks_skip_hidden_and_scripts(page):
    blocks = page.text_blocks
    assert blocks[0] == "Main Heading" and 'First paragraph with "quotes" and a break' in blocks
    assert not any("secret" in b or "gone" in b or "var a" in b for b in blocks)


def test_outline_depth_follows_the_stack(page):
    tags = [(e.tag, e.depth) for e in page.dom_outline]
    assert tags[0] == ("body", 0) and ("h1", 1) in tags and ("br", 2) in tags
    # the second list item opens inside the first, which was never closed
    assert ("li", 2) in tags and ("li", 3) in tags and ("b", 4) in tags
    assert page.dom_outline[0].classes == ["home", "page"]
    assert ("footer", 1) in tags


def test_links_images_forms(page):
    assert [(x.url, x.is_external) for x in page.links] == [
        ("https://site.example/a/up.html", False), ("https://other.example/", True),
    ]
    assert page.links[0].title == "T" and page.links[0].text == "Up link"
    assert page.images[0].url == "https://site.example/a/b/i.png" and page.images[0].alt == "pic"
    form = page.forms[0]
    assert form.action == "/go" and form.method == "post"
    assert [(i.name, i.id, i.required) for i in form.inputs] == [("q", "", True), ("t", "", False), ("", "s", False)]


def test_main_content_falls_back_to_the_body_without_sides(page):
    assert "Main Heading" in page.main_content and "Footer" not in page.main_content


def test_main_selectors_by_priority(spark):
    html = "<body><article>art</article><div id='content'>by id</div><div role='main'>by role</div></body>"
    df = spark.createDataFrame([(1, "http://x/", html)], "page_id long, url string, html string")
    assert pg.main_content(pg.parse(df)).first().main_content == "by role"


def test_features_of_an_empty_page(spark):
    df = spark.createDataFrame([(1, "http://x/", "")], "page_id long, url string, html string")
    row = pg.features(pg.extract(df)).first()
    assert row.word_count == 0 and row.links_per_word == 0.0 and row.dom_depth == 0 and not row.has_main_content


@pytest.mark.parametrize("base", ["https://h.example:8080/a/b?x=1", "http://h.example", "http://h.example/a/"])
def test_addresses_resolve_like_the_standard_library(spark, base):
    hrefs = ["c", "/c?d=1", "../c", "../../c", "./c/./d", "?q=2", "//o.example/p", "mailto:a@b", "http://z/", "c/../d/", "c#f"]
    df = spark.createDataFrame([(base, x) for x in hrefs], "b string, x string")
    got = {r.x: r.u for r in df.select("x", h.resolve(F.col("b"), F.col("x")).alias("u")).collect()}
    assert got == {x: urljoin(base, x) for x in hrefs}


def test_stray_end_tags_are_ignored(spark):
    df = spark.createDataFrame([(1, "http://x/", "<body></p><div>some text here</span></div></body>")], "page_id long, url string, html string")
    row = pg.extract(df).first()
    assert row.text_blocks == ["some text here"] and [(e.tag, e.depth) for e in row.dom_outline] == [("body", 0), ("div", 1)]


def parsed(spark, *pages):
    rows = [(i, "http://x.example/", page) for i, page in enumerate(pages)]
    return pg.parse(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_quoted_ends_and_stray_openings(spark):
    html = """<body><p>a < b and 1<2 <<i>x</i></p><a title="a>b" href='/q?x="1"'>go</a><b title=it's>c</b><img alt=">" src=i>< end <a href="cut"""
    tokens = parsed(spark, html).first().tokens
    assert tokens[2:5] == ["a < b and 1<2 ", "<", "<i>"] and """<a title="a>b" href='/q?x="1"'>""" in tokens
    assert tokens[-4:] == ["</b>", """<img alt=">" src=i>""", "< end ", '<a href="cut'] and "".join(tokens) == html
    row = pg.extract(parsed(spark, html)).first()
    assert [(x.url, x.text, x.title) for x in row.links] == [('http://x.example/q?x="1"', "go", "a>b")]


def test_character_references_decode_like_the_standard_library(spark):
    texts = ["caf&#233; &eacute;", "&amp;lt;", "a & b &unknown; &", "&#x1F600;&#X41;", "&#128;&#150;", "&#0;&#xD800;&#x110000;", "&Aacute;&NotEqualTilde;", "&#00065;&#x00000041;&#0000000233;"]
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", h.decode(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == {x: unescape(x) for x in texts}


def test_children_and_hidden_spans(spark):
    html = "<body><p>a</p><p hidden style='display:none'>b<i>c</i></p><br>d</body>"
    rows = parsed(spark, html, None, "").collect()
    assert [(n.tag, n.pos, n.end, n.parent, n.children) for n in rows[0].nodes] == [
        ("body", 0, 12, -1, 3), ("p", 1, 3, 0, 1), (None, 2, 2, 1, 0), ("br", 10, 11, 0, 0), (None, 11, 11, 0, 0),
    ]
    assert [(s.pos, s.end, s.tag) for s in rows[0].hidden] == [(4, 9, "p")] and rows[0].texts[11] == "d"
    assert rows[1].nodes is None and rows[2].nodes == []


def test_long_pages_take_linear_time(spark):
    row = parsed(spark, "<body>" + "<div><p>x</p></div>" * 20000 + "<div>" * 20000).selectExpr("size(nodes) n", "nodes[0].children c").first()
    assert (row.n, row.c) == (80001, 20001)


def test_texts_of_a_long_page_are_cleaned_once_for_all_its_elements(spark):
    n = 6000
    page = "<html><body>" + "".join(f"<p>paragraph number {k} a&amp;b</p><a href='/{k}'>x</a>" for k in range(n)) + "</body></html>"
    parsed = pg.parse(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string"))
    start = time.time()
    assert pg.text_blocks(parsed).select(F.size("text_blocks")).first()[0] == n
    assert pg.links(parsed).select(F.size("links")).first()[0] == n
    assert time.time() - start < 25
