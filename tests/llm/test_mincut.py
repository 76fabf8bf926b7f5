from __future__ import annotations

import html
import random
import re
import time
from itertools import product

import pytest

from paneledger.llm.mincut import blocks, extract, main_text, minimum_cut
from paneledger.llm.registry import queries

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1><p>We write things. Every single day of the year, for you.</p></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site to make things better for everyone.</div>
<main><article><header><h1>Real &amp; title</h1></header>
<p>First paragraph with   some <b>bold</b> text and <a href=x>a link</a>.
<p>Second&nbsp;one &#8212; long enough to be a paragraph, unclosed.
<div class="ad">Buy now! Only today, only here, you will not regret this purchase.</div>
<script>document.write("<p>no</p>")</script><form>Name <input> <p>mail</p></form>
<blockquote>A quote that belongs to the text.</blockquote><ul><li>an item</li><li>another item</li></ul>
<aside><p>A sidebar inside of the article that nobody wants to read at all.</p></aside>
<section class="comments"><article><p>Great post! I really liked reading all of it, thank you.</p></article></section>
</article></main><footer><p>&copy; 2024 Site, all rights reserved.</p></footer></body></html>"""


def test_parts_of_a_page():
    assert main_text(PAGE) == (
        "Real & title First paragraph with some bold text and a link. Second one — long enough to be a paragraph, unclosed. "
        "A quote that belongs to the text. an item another item")


def test_without_an_article_tag():
    page = ("<div class=menu><a href=1>Home</a> <a href=2>News</a></div><div><p>" + "A plain paragraph of the story. " * 4 + "</p><p>"
            + "It goes on for a while, as they do. " * 4 + "</p></div><div class='footer'>Contact us</div>")
    assert main_text(page) == ("A plain paragraph of the story. " * 4 + "It goes on for a while, as they do. " * 4).strip()


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p", ""), ("<!-- never ended <p>x</p>", ""), ("<script>x", ""), ("</div></p>", ""),
    ("<article>a < b &lt; c &am</article>", "a < b < c &am"), ("<article>one<br>two<!-- x -->three", "one twothree"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_minimum_cut_as_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        keep, drop = ([rng.choice([0.0, 0.5, 1.0, 2.5, 4.0]) + rng.random() / 100 for _ in range(n)] for _ in range(2))
        ties = {(a, b): rng.choice([0.3, 1.0, 3.0]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def price(labels):
            return (sum(d if label else k for label, k, d in zip(labels, keep, drop))
                    + sum(c for (a, b), c in ties.items() if labels[a] != labels[b]))

        best = min(price(labels) for labels in product([False, True], repeat=n))
        assert abs(price(minimum_cut(keep, drop, ties)) - best) < 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "<article>" + "<p>word word.</p>" * 20_000 + "</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = extract(frame).collect()
    assert len(got) == 4 and all(row.n_chars == len(row.text) for row in got)
    assert [row.text for row in got if row.page_id == 2] == [" ".join(["word word."] * 20_000)]
    assert extract(frame.limit(0)).collect() == []


def articles(page: str) -> str:
    """The whole text of the article element: what these pages mean by main text."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    parts = (" ".join(html.unescape(part).split()) for part in re.split(r"<[^>]*>", re.sub(r"</?b>", "", inner)))
    return " ".join(part for part in parts if part)


def test_query(spark, small):
    pages = {row.page_id: row.html for row in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries()["op5_main_text"](spark, small).collect()
    assert len(rows) == len(pages) and all(row.text == articles(pages[row.page_id]) for row in rows)


@pytest.mark.parametrize("html, text", [
    ("<p data-x=it's>Hello it's me and this is the long main text of a page.</p>", "Hello it's me and this is the long main text of a page."),
    ('<p title="5" tall">First paragraph of a text that is long enough.</p>', "First paragraph of a text that is long enough."),
    ("<p title='a > b' class=\"x\">Quoted signs do not end a tag, as everyone knows.</p>", "Quoted signs do not end a tag, as everyone knows."),
    ('<p data-y="class=ad">Values are not attributes of their own, of course.</p>', "Values are not attributes of their own, of course."),
    ("<p a = 'x>y' b>Blanks may stand around the sign between name and value.</p>", "Blanks may stand around the sign between name and value."),
])
def test_tags_are_read_as_html_does(html, text):
    assert main_text(html) == text


def test_deep_pages_take_no_square_time():
    start = time.perf_counter()
    assert len(blocks("<div>x " * 50_000)) == 50_000
    main_text("<span>" * 50_000 + "<p>y</x>" * 50_000)
    assert time.perf_counter() - start < 10
