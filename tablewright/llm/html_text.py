"""Main text of web pages from flat text blocks.

A page is read once into blocks, the text between block-level tags.  Each has its word count and link density
(share of words inside links), those of the neighbouring blocks, where it stands (in an article, outside one,
on a page without any, or in a part that the page marks as furniture) and how much of the page stands there.
A decision tree, grown on the small labelled table below, asks for the place first, then for counts and
densities, and keeps or drops the block.  Class names mark a part as furniture only where it is no layout of the whole page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, table

# Elements of HTML, and the words by which pages name their parts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noframes noscript ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset("script style noscript template textarea title svg math iframe object canvas audio video head select datalist".split())
RAW_TAGS = frozenset("script style textarea title noscript template svg math iframe object canvas audio video select datalist".split())
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu button".split())
SECTION_TAGS = frozenset(
    "article aside body button dialog div dl fieldset figure footer form header html li main menu nav ol section table td th tr ul".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments comentarios cookie cookies "
    "consent copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain pager "
    "pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe taboola tags toolbar topbar widget".split())
LAYOUT_NAMES = frozenset("has with without no show hide".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s<>/"']*)((?:"[^"]*"|'[^']*'|[^<>"'])*+)>|<[!?][^<>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Places of a block.
FURNITURE, OUTSIDE, OPEN, INSIDE = 0, 1, 2, 3
FEATURES = ("place", "share", "words", "links", "words_before", "links_before", "words_after", "links_after")
#: The labelled table: blocks of pages of common kinds, in the order of FEATURES, and 1 for main text.  OPEN
#: blocks are those of pages without an article element.  The share is that of the place among the page's words
#: (for blocks outside furniture, among the words outside furniture); neighbours are of the same place.
LABELLED = (
    # articles: headline, paragraphs long and short, list entries, quotes, captions, link-rich paragraphs
    (INSIDE, 1.0, 8, 0.0, 0, 0.0, 60, 0.0, 1), (INSIDE, 0.95, 60, 0.05, 8, 0.0, 45, 0.0, 1), (INSIDE, 0.9, 1, 0.0, 40, 0.0, 30, 0.0, 1),
    (INSIDE, 1.0, 3, 0.0, 0, 0.0, 4, 0.5, 1), (INSIDE, 0.8, 12, 0.4, 50, 0.1, 33, 0.0, 1), (INSIDE, 1.0, 2, 1.0, 20, 0.0, 25, 0.0, 1),
    (INSIDE, 0.6, 150, 0.0, 90, 0.1, 6, 0.2, 1), (INSIDE, 0.4, 5, 0.0, 5, 0.0, 5, 0.0, 1), (INSIDE, 1.0, 25, 0.9, 12, 0.3, 18, 0.0, 1),
    (INSIDE, 0.9, 4, 0.0, 30, 0.0, 2, 0.0, 1), (INSIDE, 1.0, 2, 0.0, 1, 0.0, 0, 0.0, 1), (INSIDE, 1.0, 1, 1.0, 3, 0.0, 1, 0.0, 1),
    (INSIDE, 0.7, 6, 0.0, 2, 1.0, 3, 1.0, 1), (INSIDE, 1.0, 3, 0.7, 5, 0.0, 2, 0.0, 1), (INSIDE, 0.9, 2, 0.0, 4, 1.0, 1, 0.0, 1),
    (INSIDE, 1.0, 7, 1.0, 0, 0.0, 55, 0.0, 1), (INSIDE, 0.9, 5, 0.5, 8, 0.2, 3, 0.0, 1), (INSIDE, 1.0, 1, 0.0, 2, 0.0, 2, 0.0, 1),
    (INSIDE, 0.9, 8, 0.0, 60, 0.0, 1, 1.0, 1), (INSIDE, 1.0, 3, 0.0, 70, 0.0, 3, 0.0, 1), (INSIDE, 1.0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    (INSIDE, 0.2, 14, 0.1, 0, 0.0, 9, 0.0, 1), (INSIDE, 0.1, 22, 0.0, 5, 0.0, 0, 0.0, 1), (INSIDE, 1.0, 30, 0.0, 1, 1.0, 1, 1.0, 1),
    (INSIDE, 1.0, 1, 0.0, 1, 1.0, 80, 0.0, 1), (INSIDE, 1.0, 40, 0.0, 0, 0.0, 0, 0.0, 1), (INSIDE, 0.9, 18, 0.85, 40, 0.0, 1, 1.0, 1),
    # menus inside articles: contents, tags, related pages; their first and last entries border on text
    (INSIDE, 1.0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (INSIDE, 0.9, 4, 1.0, 2, 1.0, 5, 1.0, 0), (INSIDE, 1.0, 2, 1.0, 60, 0.0, 1, 1.0, 0),
    (INSIDE, 0.8, 2, 1.0, 1, 1.0, 45, 0.0, 0), (INSIDE, 0.9, 7, 1.0, 6, 1.0, 4, 1.0, 0), (INSIDE, 1.0, 3, 1.0, 2, 1.0, 0, 0.0, 0),
    (INSIDE, 0.1, 6, 1.0, 5, 1.0, 7, 1.0, 0), (INSIDE, 0.6, 3, 1.0, 8, 0.0, 4, 1.0, 0), (INSIDE, 1.0, 5, 0.9, 3, 1.0, 30, 0.0, 0),
    # marked furniture: menus, adverts, notices, forms, footers, comments
    (FURNITURE, 0.1, 1, 1.0, 1, 1.0, 1, 1.0, 0), (FURNITURE, 0.3, 9, 0.0, 1, 1.0, 0, 0.0, 0), (FURNITURE, 0.6, 40, 0.0, 12, 0.0, 55, 0.0, 0),
    (FURNITURE, 0.2, 7, 0.3, 8, 0.0, 0, 0.0, 0), (FURNITURE, 0.7, 120, 0.0, 30, 0.0, 60, 0.0, 0), (FURNITURE, 1.0, 3, 0.0, 2, 0.0, 1, 0.0, 0),
    (FURNITURE, 0.4, 200, 0.0, 110, 0.0, 90, 0.0, 0), (FURNITURE, 0.9, 95, 0.0, 70, 0.0, 85, 0.0, 0), (FURNITURE, 1.0, 25, 0.0, 1, 1.0, 0, 0.0, 0),
    (FURNITURE, 1.0, 45, 0.1, 20, 0.0, 6, 1.0, 0), (FURNITURE, 1.0, 2, 1.0, 1, 1.0, 90, 0.0, 0), (FURNITURE, 1.0, 110, 0.8, 3, 1.0, 4, 1.0, 0),
    # pages that a form or another mark encloses whole: their paragraphs
    (FURNITURE, 1.0, 80, 0.0, 60, 0.0, 95, 0.0, 1), (FURNITURE, 1.0, 130, 0.1, 9, 0.0, 75, 0.0, 1), (FURNITURE, 1.0, 100, 0.0, 85, 0.0, 1, 1.0, 1),
    # around an article: teasers, related headlines, legal lines
    (OUTSIDE, 0.1, 14, 0.0, 1, 1.0, 9, 0.0, 0), (OUTSIDE, 0.2, 6, 1.0, 7, 0.0, 6, 1.0, 0), (OUTSIDE, 0.3, 45, 0.0, 8, 0.0, 3, 0.5, 0),
    (OUTSIDE, 0.05, 2, 0.0, 4, 0.0, 4, 1.0, 0), (OUTSIDE, 0.4, 30, 0.2, 5, 1.0, 28, 0.3, 0), (OUTSIDE, 0.6, 90, 0.0, 40, 0.0, 75, 0.0, 0),
    (OUTSIDE, 0.5, 60, 0.0, 0, 0.0, 50, 0.0, 0), (OUTSIDE, 0.02, 5, 0.0, 0, 0.0, 0, 0.0, 0),
    # beside an article that is a teaser: the page's paragraphs and headings, against menus and other teasers' links
    (OUTSIDE, 0.9, 70, 0.0, 6, 0.0, 55, 0.0, 1), (OUTSIDE, 0.85, 28, 0.1, 60, 0.0, 40, 0.0, 1), (OUTSIDE, 0.95, 12, 0.0, 0, 0.0, 65, 0.0, 1),
    (OUTSIDE, 0.9, 5, 0.0, 0, 0.0, 48, 0.0, 1), (OUTSIDE, 0.9, 35, 0.0, 20, 0.0, 0, 0.0, 1), (OUTSIDE, 0.9, 1, 1.0, 1, 1.0, 1, 1.0, 0),
    (OUTSIDE, 0.95, 6, 1.0, 5, 1.0, 4, 1.0, 0), (OUTSIDE, 0.85, 3, 1.0, 40, 0.0, 2, 1.0, 0), (OUTSIDE, 0.9, 8, 0.9, 1, 1.0, 0, 0.0, 0),
    # pages without an article element: paragraphs and their headings against menus, teasers and legal lines
    (OPEN, 1.0, 80, 0.0, 6, 0.0, 70, 0.0, 1), (OPEN, 1.0, 35, 0.1, 60, 0.0, 3, 1.0, 1), (OPEN, 1.0, 6, 0.0, 2, 1.0, 75, 0.0, 1),
    (OPEN, 1.0, 4, 0.0, 55, 0.0, 48, 0.0, 1), (OPEN, 1.0, 20, 0.0, 7, 0.0, 22, 0.0, 1), (OPEN, 1.0, 9, 0.0, 65, 0.0, 1, 1.0, 1),
    (OPEN, 1.0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (OPEN, 1.0, 3, 1.0, 30, 0.0, 2, 1.0, 0), (OPEN, 1.0, 5, 0.6, 2, 1.0, 4, 0.8, 0),
    (OPEN, 1.0, 18, 0.8, 15, 0.9, 20, 0.7, 0), (OPEN, 1.0, 4, 0.0, 1, 1.0, 1, 1.0, 0), (OPEN, 1.0, 3, 0.0, 2, 1.0, 0, 0.0, 0),
    (OPEN, 1.0, 7, 0.0, 3, 1.0, 2, 1.0, 0), (OPEN, 1.0, 28, 0.7, 6, 1.0, 40, 0.0, 0), (OPEN, 1.0, 40, 0.0, 0, 0.0, 30, 0.0, 1),
    (OPEN, 1.0, 30, 0.0, 40, 0.0, 1, 1.0, 1), (OPEN, 1.0, 110, 0.1, 12, 0.0, 0, 0.0, 1), (OPEN, 1.0, 15, 0.0, 18, 0.1, 90, 0.0, 1),
    (OPEN, 1.0, 50, 0.2, 0, 0.0, 0, 0.0, 1), (OPEN, 1.0, 22, 0.0, 1, 1.0, 2, 1.0, 1), (OPEN, 1.0, 70, 0.0, 3, 1.0, 4, 1.0, 1),
    (OPEN, 1.0, 12, 0.0, 33, 0.0, 27, 0.0, 1), (OPEN, 1.0, 5, 0.0, 45, 0.0, 38, 0.1, 1), (OPEN, 1.0, 2, 0.0, 36, 0.0, 52, 0.0, 1),
    (OPEN, 1.0, 8, 1.0, 48, 0.0, 9, 1.0, 0), (OPEN, 1.0, 12, 0.9, 5, 1.0, 66, 0.0, 0), (OPEN, 1.0, 2, 1.0, 0, 0.0, 1, 1.0, 0),
    (OPEN, 1.0, 25, 0.6, 40, 0.1, 38, 0.0, 0), (OPEN, 1.0, 5, 0.0, 0, 0.0, 1, 1.0, 0), (OPEN, 1.0, 2, 0.0, 1, 1.0, 3, 0.6, 0),
    (OPEN, 1.0, 6, 0.2, 4, 1.0, 0, 0.0, 0), (OPEN, 1.0, 60, 0.5, 6, 1.0, 5, 1.0, 0), (OPEN, 1.0, 4, 0.0, 0, 0.0, 0, 0.0, 0),
)
#: Of each place's part of the tree; the least of those that leaving out a row of the table finds best.
DEPTH = 3


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    named: tuple[int, ...] = ()


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """2 for what is furniture by its element, role or style, 1 by its class or id only, else 0."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return 2
    named = 0
    for found in _ATTRIBUTE.finditer(attributes):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 2
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return 2
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for one in value.split():
                words = [w.lower() for w in _NAME.findall(one)]
                if words and words[0] not in LAYOUT_NAMES and not FURNITURE_NAMES.isdisjoint(words):
                    named = 1
    return named


def blocks(page: str) -> list[Block]:
    """Text blocks in page order.  Unclosed and stray tags are taken as browsers take them, as far as blocks need it."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # section, in furniture, in an article, in parts named as furniture
    links = at = parts_named = 0
    holds_article: set[int] = set()

    def close() -> None:
        if parts:
            text = unescape("".join(p for p, _ in parts))
            words = text.split()
            if words:
                linked = sum(len(unescape(p).split()) for p, a in parts if a)
                _, furniture, article, named = stack[-1] if stack else ("", False, False, ())
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), furniture, article, named))
            parts.clear()

    while True:
        token = _TOKEN.search(page, at)
        end = token.start() if token else len(page)
        if end > at:
            parts.append((page[at:end], links > 0))
        if not token:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        closing = bool(token[1])
        if tag in RAW_TAGS and not closing and not token[3].rstrip().endswith("/"):
            last = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = last.end() if last else len(page)
        if tag in BLOCK_TAGS or tag in RAW_TAGS:
            close()
        if tag in BLOCK_TAGS:
            links = 0
        elif tag == "br":
            parts.append((" ", False))
        elif tag == "a":
            links = 0 if closing else 1
        if tag in SECTION_TAGS and tag not in RAW_TAGS:
            if not closing:
                inside = stack[-1] if stack else ("", False, False, ())
                article = inside[2] or tag in ("article", "main")
                if tag in ("article", "main"):
                    holds_article.update(inside[3])
                if not token[3].rstrip().endswith("/") or tag in ("div", "section"):
                    marked, named = _furniture(tag, token[3], inside[2]), inside[3]
                    if marked == 1 and not inside[1] and not named:
                        named = (parts_named,)
                        parts_named += 1
                    stack.append((tag, inside[1] or marked == 2, article, named))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
        elif tag in BLOCK_TAGS and not closing and _furniture(tag, token[3], True):
            last = re.compile(rf"</{re.escape(tag)}\b[^>]*>|<(?:p|div|h[1-6]|/?article|/?main|/?section|/?body)\b", re.I).search(page, at)
            at = last.start() if last else len(page)
    close()
    return _settle_names(out, holds_article)


def _settle_names(found: list[Block], holds_article: set[int]) -> list[Block]:
    """Blocks of parts that only their names call furniture: they are, unless such a part holds an article, or
    more than half of the words of a page without any."""
    words: dict[int, int] = {}
    total, articles = 0, False
    for b in found:
        if not b.furniture:
            total += b.words
            articles |= b.article
            for part in b.named:
                words[part] = words.get(part, 0) + b.words
    for b in found:
        b.furniture |= any(part not in holds_article and (articles or 2 * words.get(part, 0) <= total) for part in b.named)
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row per block, in the order of FEATURES; a neighbour in another place counts as none."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    has_article = any(b.article and not b.furniture for b in found)
    place = np.array([FURNITURE if b.furniture else INSIDE if b.article else OUTSIDE if has_article else OPEN for b in found])
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked for b in found]) / words
    held = np.bincount(place, words, 4)
    of = np.full(4, max(held[1:].sum(), 1.0))
    of[FURNITURE] = words.sum()
    same = place[1:] == place[:-1]
    before, after = np.append(False, same), np.append(same, False)
    row = [place, (held / of)[place], words, links, np.roll(words, 1) * before, np.roll(links, 1) * before, np.roll(words, -1) * after, np.roll(links, -1) * after]
    return np.stack(row, 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, at or below, above), or (label,) for a leaf.  The best cut
    is the first of equals, halfway between two neighbouring values."""
    if depth == 0 or len(set(y)) == 1:
        return (int(2 * y.sum() >= len(y)),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return (int(2 * y.sum() >= len(y)),)
    _, f, cut, low = best
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(1)
def default_tree() -> tuple:
    rows = np.array(LABELLED, float)
    return by_place(rows[:, :-1], rows[:, -1])


def by_place(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A tree that asks for the place first, and below for what the table's rows of that place tell apart."""
    own = [grow(x[x[:, 0] == place], y[x[:, 0] == place], depth) for place in (FURNITURE, OUTSIDE, OPEN, INSIDE)]
    tree = own[INSIDE]
    for place in (OPEN, OUTSIDE, FURNITURE):
        tree = (0, place + 0.5, own[place], tree)
    return tree


def decide(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree[0])


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """The kept blocks of a page, joined by empty lines."""
    if not page:
        return ""
    tree = tree or default_tree()
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found)) if decide(tree, row))


def extract(html: Column, tree: tuple | None = None) -> Column:
    """Main text of a whole page; empty for null, empty and textless pages.  Character references are decoded, white
    space inside a block becomes one space, blocks are joined by two line feeds in page order."""
    tree = tree or default_tree()

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return run(html)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op4_html": op4_html}
SQL: dict[str, str] = {}
