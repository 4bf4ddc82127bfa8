"""HTML read in one pass: entities, nesting, whatever is left open, and time that goes with the length."""

from __future__ import annotations

import time

import pytest

from corpuskit.operators import markup, pages


def facts(spark, html, url="https://e.org/d/p"):
    frame = spark.createDataFrame([("k", url, html)], "page_id string, url string, html string")
    return pages.page_metadata(frame).first(), pages.page_text(frame).first(), {r.target: r.n for r in pages.page_links(frame).collect()}


def test_entities(spark):
    m, t, links = facts(spark, "<title>It&#8217;s &#x41; &eacute; &amp;lt; &bogus; &copy</title><p>A sentence &mdash; &#128512; &Auml;.</p><a href='/q?a=1&copy=2&amp;b=3'>x</a>")
    assert m.title == "It’s A é &lt; &bogus; ©"
    assert t.text == "A sentence — 😀 Ä."
    assert links == {"https://e.org/q?a=1&b=3&copy=2": 1}


def test_escapes_want_their_semicolon(spark):
    """A title that was cut within an escape keeps what is left of it, as the SQL has it."""
    m, t, _ = facts(spark, "<title>a &amp; b &amp;&amp</title><p>&lt;x&gt; &ltimes; &lt and &nbsp &ampfoo; &#39 &#39; &#393; &copy 2 end.</p>")
    assert m.title == "a & b &&amp"
    assert t.text == "<x> ⋉ &lt and &nbsp &ampfoo; &#39 ' Ɖ © 2 end."


def test_nested_furniture(spark):
    _, t, _ = facts(spark, "<header>One is a head.<nav>Two is a menu.</nav> Three is a head.</header><p>Four is text.</p><aside><nav>Five.<p>Six.</aside><p>Seven is text.</p><nav>Eight is left open.<p>Nine is text.</p>")
    assert t.text.split("\n") == ["Four is text.", "Seven is text.", "Eight is left open.", "Nine is text."]


def test_raw_text_and_hidden_tags(spark):
    html = """<script>var x = "<title>no</title><a href='/no'>"; if (a<b) y();</script><noscript><meta name="description" content="no"><title>No</title></noscript>
<style>p > a {}</style><title>Yes</title ><textarea><p>Not text at all, though it is a sentence.</textarea><meta name=description content=plain><p>Text with 1 < 2 and a > b.</p>"""
    m, t, links = facts(spark, html)
    assert (m.title, m.description) == ("Yes", "plain") and links == {}
    assert "Text with 1 < 2 and a > b." in t.text and "var" not in t.text


def test_json_ld(spark):
    html = """<script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle", "Thing"], "author": [{"name": "Ada L."}], "datePublished": "2024-05-06"}, 3], "@type": "WebPage"}</script>
<script type="application/ld+json">{broken "@type": "Nope"</script><script type="application/ld+json">[{"@type": "VideoObject", "author": "B"}]</script>"""
    m, _, _ = facts(spark, html)
    assert m.ld_types == ["WebPage", "NewsArticle", "Thing", "VideoObject"] and m.byline == "Ada L." and m.published == "2024-05-06"


def test_papers(spark):
    html = """<meta name="citation_title" content="On  &alpha;"><meta name="citation_author" content="A, B"><meta name="citation_author" content="C, D">
<meta name="citation_date" content="2020/01/02"><meta name="citation_pdf_url" content="https://e.org/x.pdf"><meta name="description" content="What it says">"""
    frame = spark.createDataFrame([(1, "u", html), (2, "u", "<meta name='description' content='x'>"), (3, None, None)], "page_id long, url string, html string")
    (r,) = pages.paper_facts(frame).collect()
    assert r.asDict() == {"page_id": 1, "title": "On α", "authors": ["A, B", "C, D"], "abstract": "What it says", "published": "2020-01-02", "pdf_url": "https://e.org/x.pdf", "doi": None}


@pytest.mark.parametrize("part", ["<nav>", "<a href=\"x", "<!--", "<p", "</p", "<", "&", "<script>", "<a b='c' ", "<svg><p>", "&#", "<title>", "< a=\"", "<a =", "<noscript></nav>", "]]>", "<!"])
def test_time_goes_with_the_length(part):
    """Twice as much of the same takes about twice as long, and 30,000 of anything are read in no time."""
    began = time.process_time()
    markup.read_page(part * 30_000)
    assert time.process_time() - began < 3


def test_odd_pages(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "https://e.org/", "plain words only"), (4, "https://e.org/", "<b>bold</b> and a sentence."), (5, "https://e.org/", "<title></title><html lang=''>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.page_text(frame).collect()} == {1: "", 2: "", 3: "", 4: "bold and a sentence.", 5: ""}
    assert pages.page_metadata(frame).count() == 5 and pages.page_text(frame.limit(0)).count() == 0
