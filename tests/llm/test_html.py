"""Page text: hand-made pages, the table's own labels, brute force on the given pages, edge cases."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import html_text

LONG = "A sentence with enough words to be a paragraph of its own, as pages have them. "[:-1]
PAGES = {
    "<p>Alone in a page with quite a few words that stand here and go on and on for long": "Alone in a page with quite a few words that stand here and go on and on for long",
    "<article><h1>A &amp; B</h1><p>x<br>y&nbsp;z<p>two <a href=/>links</a></article>": "A & B\n\nx y z\n\ntwo links",
    "<nav><a>Menu</a></nav><main><p>Text</p><aside>Side</aside><div class='share-bar'>Share</div></main>": "Text",
    "<article>One<script>if (a<b) {'</p>'}</script> more</article>": "One\n\nmore",
    "<article><p>In<!-- <p>no</p> --> line</article><footer>Foot": "In line",
    "<article><p>Keep</p><section id=comments><p>A reader says a lot of things here</p></section><p>Last</p></article>": "Keep\n\nLast",
    "<article><p>Cut off in the mid": "Cut off in the mid",
    "<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>Body</p></article>": "Title\n\nBody",
    "<article><form><p>Mail</p><input></form><p>A<div hidden>secret</div></article>": "A",
    "<article><p class=ad>Buy</p><p>Real</p></article>": "Real",
    # a layout's name is no mark; neither is that of a part which holds the article, or most of a page
    f"<nav><a>Menu</a></nav><div class='content has-sidebar'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>": "\n\n".join([LONG] * 3),
    f"<div class=search-results><article><p>{LONG}</p></article></div>": LONG,
    f"<div class=widget-content><p>{LONG}</p><p>{LONG}</p></div><div class=widget><p>{LONG}</p></div>": f"{LONG}\n\n{LONG}",
    f"<article><p>Short</p></article><div class=comments>{f'<p>{LONG}</p>' * 5}</div>": "Short",
    # an article that is a teaser, a menu in an article, a page inside a form, notices alone
    f"<article><p>Read this as well</p></article><div>{f'<p>{LONG} {LONG}</p>' * 6}</div>": "\n\n".join(["Read this as well", *[f"{LONG} {LONG}"] * 6]),
    f"<article><p>{LONG}</p><ul><li><a>One</a><li><a>Two</a><li><a>Three more</a></ul><p>{LONG}</p></article>": f"{LONG}\n\n{LONG}",
    f"<form><p>{LONG * 5}</p><p>{LONG * 5}</p></form>": f"{LONG * 5}\n\n{LONG * 5}",
    f"<form><p>{LONG}</p></form><nav><a>Menu</a></nav><article></article>": "",
    "": "", "   ": "", "<html><title>T</title></html>": "", "<a <a <a \"": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert html_text.main_text(page) == PAGES[page]


def test_tree_learns_its_table():
    rows = np.array(html_text.LABELLED, float)
    got = [html_text.decide(html_text.default_tree(), r[:-1]) for r in rows]
    assert np.mean(np.array(got) == rows[:, -1]) > 0.97
    assert html_text.grow(rows[:3, :-1], np.ones(3)) == (1,)


def places(tree, rows):
    """Places in whose blocks the tree asks for more than the place on some way down."""
    asked = set()
    for row in rows:
        node, own = tree, False
        while len(node) == 4:
            own |= html_text.FEATURES[node[0]] not in ("place", "share")
            node = node[2] if row[node[0]] <= node[1] else node[3]
        asked |= {int(row[0])} if own else set()
    return asked


def test_counts_and_densities_decide_in_every_place():
    rows = np.array(html_text.LABELLED, float)
    for place in range(4):
        assert set(rows[rows[:, 0] == place, -1]) == {0, 1}
    assert places(html_text.default_tree(), rows) == {0, 1, 2, 3}


def test_depth_is_the_best_by_leaving_one_out():
    rows = np.array(html_text.LABELLED, float)
    x, y = rows[:, :-1], rows[:, -1]
    right = {}
    for depth in range(1, 7):
        right[depth] = sum(html_text.decide(html_text.by_place(np.delete(x, i, 0), np.delete(y, i), depth), x[i]) == y[i] for i in range(len(y)))
    assert html_text.DEPTH == max(right, key=lambda d: (right[d], -d)), right


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", html_text.extract(F.col("html")).alias("text"))
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_edge_pages(spark):
    long = "<article>" + "<p>word &lt;" * 50_000
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<" * 20_000), (4, long), (5, "<div" * 20_000)], "page_id long, html string")
    got = {r.page_id: r.t for r in rows.select("page_id", html_text.extract(F.col("html")).alias("t")).collect()}
    assert got[1] == got[2] == "" and got[4].count("word <") == 50_000 and set(got) == {1, 2, 3, 4, 5}
    assert rows.limit(0).select(html_text.extract(F.col("html"))).count() == 0
