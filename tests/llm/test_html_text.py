"""Main text: given pages against their article, held-out layouts, decoding, edge rows."""

import html
import re

import numpy as np
import pytest

from martspark.llm.html_text import Page, Trees, extracted, fit, main_text, marked_pages, variants


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def article_text(inside):
    blocks = re.split(r"</?(?:p|h\d)>", inside)
    plain = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
    return "\n\n".join(b for b in plain if b)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = {r.page_id: article_text(re.search(r"<article>(.*?)</article>", r.html, re.S)[1]) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in extracted(pages, model).collect()}
    assert got == {k: (t, len(t)) for k, t in expected.items()}


def test_held_out_layouts(spark, model):
    """Pages the model has not seen, with marks taken away and boilerplate of many kinds around the text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("page_id >= 100").limit(60).collect()
    right = total = 0
    for r in pages:
        for varied, mark in variants(r.html, 1000 + r.page_id)[1:]:
            inside = re.search(rf"<{mark}>(.*)</{mark}>", varied, re.S)[1]
            inside = re.sub(r'<(div|section) (?:class|id)="[a-z-]+">.*?</\1>', "<p>", inside, flags=re.S)
            expected = set(article_text(inside).split("\n\n"))
            got = set(main_text(varied.replace("x-main", "div"), model).split("\n\n"))
            right += len(expected & got)
            total += max(len(expected), len(got))
    assert right >= 0.93 * total


def test_a_page_with_everything_around(model):
    words = "Long sentences make up the story, and they go on for a while. " * 6
    page = (f'<html><head><title>T</title></head><body><header><p>Site name</p></header><div class="menu"><ul>'
            f'<li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class="cookie-notice"><p>We use cookies.</p></div>'
            f'<article><h1>Head &amp; line</h1><p>{words}<p>{words}</p><div class="ad"><p>Buy now</p></div><p>{words}</article>'
            f'<aside><h3>More</h3><ul><li><a href=3>Three</a></ul></aside><form><p>Mail</p><input></form>'
            f'<section id="comments"><div class="comment"><p>Nice story, thanks</p></div></section><footer>(c)</footer>')
    line = " ".join(words.split())
    assert main_text(page, model) == "\n\n".join(["Head & line", line, line, line])


def test_decoding_never_contradicts():
    page = Page("<div><p>one</p><div><p>two</p><p>three</p></div></div>")
    rng = np.random.default_rng(1)
    x = page.features()
    for _ in range(200):
        scores = rng.normal(size=len(x))
        kept = page.kept(scores)
        n = len(page.tags)
        below = lambda k: [j for j in range(n) if j == k or (j > k and below_of(j, k))]

        def below_of(j, k):
            while j > 0:
                j = page.parents[j]
                if j == k:
                    return True
            return False

        whole = scores.sum()
        if whole > 0 and (scores > 0).all():
            assert kept.all()
        if (scores < 0).all():
            assert not kept.any()
        assert len(kept) == n and below(0) == list(range(n))


EDGE = [None, "", "plain text only, without any markup at all, in one line", "<p>unclosed <b>bold<p>next", "<script>x</p></script>",
        "<div " * 50, "</p></div>", "&lt;p&gt; &#233; &nope; &amp", "<p>" + "w " * 200_000, "<div>" * 3000 + "deep" + "</div>" * 3000]


def test_edge_rows(spark, model):
    rows = [(k if k % 4 else None, None if k % 3 else "u", h, 1) for k, h in enumerate([*EDGE, EDGE[3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = extracted(pages, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    long = "a text long enough for the fixed rule"
    assert main_text(f"<p>{long} <b>bold<p>{long}", Trees([])) == f"{long} bold\n\n{long}"
    assert main_text(None, model) == main_text(EDGE[4], model) == ""
    empty = pages.limit(0)
    assert extracted(empty).count() == 0
    assert {r.text for r in extracted(pages.filter("html like '%plain%'")).collect()} == {EDGE[2]}  # no marks: fixed rule


def test_rare_marked_pages_are_learned_from(spark):
    """Few marked pages among many without marks, and copies of one: each distinct marked page is in the sample."""
    words = "Long sentences make up the story, and they go on for a while. " * 3
    page = '<html><body><nav><a href=1>One</a></nav><{0}><h1>Head {1}</h1><p>{2}</p></{0}></body></html>'
    marked = {page.format(tag, k, words) for k, tag in enumerate(["article", "main", "ARTICLE"])}
    other = [f"<div><p>{words} {k}</p></div>" for k in range(3000)] + ["<main>a</main><article>b</article>", None]
    htmls = [*other, *marked, *[min(marked)] * 500]
    pages = spark.createDataFrame([(k, "u", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    got = [r.html for r in marked_pages(pages).collect()]
    assert len(got) == 3 and set(got) == marked
    assert [r.html for r in marked_pages(pages.repartition(3), 2).collect()] == got[:2]
    assert fit(pages).trees
