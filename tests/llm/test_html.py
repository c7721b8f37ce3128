"""Whole pages: deep containers, long blocks, unclosed elements, pages without article or main."""

from __future__ import annotations

import html as html_lib
import random
import re
import time

import numpy as np
import pytest
from conftest import SMALL

from midden.llm import html_blocks


def test_vectors_see_all_of_a_block():
    deep = (("li", ()),) * 8
    a, b = ((html_blocks.node(("div", (name,)), *deep), "same text", 0) for name in ("comments", "content"))
    assert not np.array_equal(html_blocks.vectors([a]), html_blocks.vectors([b]))
    long = "word " * 3000
    x, y = (html_blocks.vectors([(None, long + end, 0)])[0] for end in ("alpha, beta.", "gammas delta."))
    assert not np.array_equal(x, y)
    assert html_blocks.blocks('<p class="a b c d e f sidebar">x')[0][0].names[-1] == "sidebar"


def test_unclosed_elements_hide_nothing_else():
    own = lambda html: [t for _, t, _ in html_blocks.blocks(html)]
    assert own("<html><head><title>t</title><body><p>one") == ["one"]
    assert own("<head><meta charset=x><p>one") == ["one"] and own("<head><title>t</title>one") == ["one"]
    assert own("<head><noscript>x<body><p>one</p></body>") == ["one"]
    assert own("<body><noscript>x<p>one</p><p>two") == ["one", "two"]
    assert own("<div><select><option>x</div><p>one") == ["one"] and own("<select><option>x<p>one") == ["one"]
    assert own("<object><noscript>x<p>one") == ["one"]
    assert own("<p>a</p><noscript><p>b</p></noscript><object><div>c</div></object><p>d") == ["a", "d"]


def test_pages_without_article_or_main(spark):
    kind = "page_id long, url string, html string"
    page = '<div class="menu"><a>Home page</a></div><{0}><p>The {1} long text of the page, with words.</p></{2}>'
    named = spark.createDataFrame([(i, "u", page.format('div class="content"', i, "div")) for i in range(40)], kind)
    model = html_blocks.fit(named)
    assert model is not None
    assert all(r["text"] == f"The {r['page_id']} long text of the page, with words." for r in html_blocks.extract(named, model).collect())
    plain = spark.createDataFrame([(i, "u", page.format("div", i, "div")) for i in range(4)], kind)
    assert html_blocks.fit(plain) is None
    assert all(r["text"] == f"The {r['page_id']} long text of the page, with words." for r in html_blocks.extract(plain, None).collect())


def test_deep_comments_are_no_text(spark):
    model = html_blocks.fit(spark.read.parquet(f"{SMALL}/pages.parquet"))
    words = "and this is what a reader of the page has to say about it, at some length."
    page = "<article>" + f"<p>{words}</p>" * 5 + "</article><div class=comments>" + "<ul><li>" * 4 + "<div>" + f"<p>{words}</p>" * 4
    found = html_blocks.blocks(page)
    assert model.label([html_blocks.vectors(found)])[0].tolist() == [True] * 5 + [False] * 4


@pytest.mark.parametrize("unit,rows", [("<li>item <b>x</b>", 100_000), ("<tr><td>a<td>b", 100_000), ("<dt>a<dd>b", 100_000), ("<option>x", 0), ("<p>y", 50_000)])
def test_unclosed_items_take_linear_time(unit, rows):
    open_tag = {"<l": "<ul>", "<t": "<table>", "<d": "<dl>", "<o": "<select>", "<p": "<div>"}[unit[:2]]
    began = time.process_time()
    n = 50_000 if "<td>" in unit or "<dd>" in unit or "<p>" in unit else 100_000
    found = html_blocks.blocks(f"<body>{open_tag}{unit * n}")
    assert len(found) == rows and time.process_time() - began < 30
    assert len({depth(p) for p, _, _ in found}) <= 2


def depth(place) -> int:
    return 0 if place is None else 1 + depth(place.parent)


def test_scripts_dont_cut_words():
    found = html_blocks.blocks("<body><article><p>wo<script>x < y</script>rd and<style>p {}</style> more</p><p>next<object>hidden</object>one</article>")
    assert [t for _, t, _ in found] == ["word and more", "next", "one"]


@pytest.mark.parametrize("tag", sorted(html_blocks.UNSURE))
@pytest.mark.parametrize("unit", ["<{0}>", "<{0}>text", "<{0}><p>text</p>", "<{0}>x<p>"])
def test_unclosed_hiding_elements_in_linear_time(tag, unit):
    began = time.process_time()
    html_blocks.blocks("<body>" + unit.format(tag) * 100_000 + "<p>end")
    html_blocks.blocks("<body>" + unit.format(tag) * 100_000 + f"</{tag}>" * 100_000)
    assert time.process_time() - began < 60


def test_article_after_unclosed_items():
    found = html_blocks.blocks("<body><nav><ul><li>a<li>b<ul><li>c</ul><li>d</ul></nav><table><tr><td>x<td>y<tr><td>z</table><article><p>one<p>two</article>")
    assert [t for _, t, _ in found] == ["a", "b", "c", "d", "x", "y", "z", "one", "two"]
    assert [html_blocks.meaning(p) for p, _, _ in found] == [0] * 4 + [-1] * 3 + [1, 1]


def test_neutral_containers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_blocks.fit(pages)
    rng = random.Random(1)
    hit = extra = lost = 0
    for row in pages.limit(100).collect():
        article = html_lib.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]))
        names: dict = {}
        html = re.sub(r'(class|id|role)="[^"]*"', lambda m, n=names: f'class="{n.setdefault(m[0], "".join(rng.choice("qxzwk") for _ in range(4)))}"', row["html"])
        html = re.sub(r"<(/?)(article|main|nav|header|footer|aside|form|section|menu|dialog)\b", r"<\1div", html)
        found = html_blocks.blocks(html)
        for (_, text, _), mark in zip(found, model.label([html_blocks.vectors(found)])[0], strict=True):
            true = " ".join(text.split()) in " ".join(article.split())
            hit, extra, lost = hit + bool(mark and true), extra + bool(mark and not true), lost + bool(true and not mark)
    assert 2 * hit / (2 * hit + extra + lost) >= 0.9


def test_pages_of_every_shape(spark):
    kinds = "page_id long, url string, html string, text string, n_chars int, mark long, says int"
    rows = [(None, None, "<body><article><p>words of text</article>", "x", 1, 2, 3), (1, "u", "<body><article><p>words of text</article>", "x", 1, 2, 3), (1, "u", "<body><article><p>words of text</article>", "x", 1, 2, 3)]
    pages = spark.createDataFrame(rows, kinds)
    got = html_blocks.extract(pages, html_blocks.fit(pages)).collect()
    assert len(got) == 3 and len({r["text"] for r in got}) == 1 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    empty = pages.limit(0)
    assert html_blocks.fit(empty) is None and html_blocks.extract(empty, None).count() == 0
