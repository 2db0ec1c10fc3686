"""Main text of web pages from flat text blocks and a decision tree.

The markup is read once, left to right, and cut into flat blocks at block-level
tags.  A block has its word count and link density, those of the blocks before
and after it, whether it is a heading, and evidence from its place: the nearest
enclosing element whose tag means content (article, main) or furniture (nav,
footer, forms ...), the nearest class, id or role name that sounds like either,
and whether other blocks of the page are marked as content.  None of these
decides alone: a decision tree (CART, Gini), grown once for each process from
the small labelled table below, keeps or drops each block.  Kept blocks are
joined in page order by a blank line.

Null and empty pages give an empty text.  Whole pages are read, however long;
markup that ends in mid-tag or is nested wrongly is read on as best it can be.
Where two splits of the tree are equally good, the earlier feature and the lower
limit win; a leaf with as many kept as dropped rows keeps.  Repeated rows give
equal results, rows with null ids and urls too, and an empty table an empty one.
Only the named columns are read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches

#: Tags that begin and end a block (fixed values).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Tags without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose inside is no text of the page (fixed values).
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head".split())
#: Those whose inside is raw text: nothing in it is markup (fixed values).
RAW = frozenset({"script", "style", "textarea"})
#: Tags that may stand in the head; any other one begins the body (fixed values).
HEAD_TAGS = frozenset("html head title base link meta script style noscript template".split())
#: Elements that hold the page's content, and those that hold its furniture (fixed values).
CONTENT_TAGS = frozenset({"article", "main"})
FURNITURE_TAGS = frozenset({"nav", "footer", "aside", "form", "menu", "dialog", "search"})
#: Words of class, id and role names that furniture has (fixed values).
_FURNITURE_WORD = re.compile(r"(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menus?|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|warning|popup|modal|overlay|comments?|commentlist|disqus|repl(?:y|ies)|respond|footer|masthead|topbar|related|recommend\w*|share|sharing|social|newsletter|subscribe|subscription|signup|login|search|pagination|pager|widgets?|toolbar|copyright|skip|contentinfo|complementary|toc|teasers?|header)")
#: Words that say only where an element stands or that it holds something (fixed values).
_NEUTRAL_WORD = re.compile(r"(?:site|page|top|bottom|main|global|left|right|primary|secondary|box|bar|list|area|wrap|wrapper|container|inner|outer|block|section|items?|links?|row|col|group|panel|button|form|message|thread|body|text|content|post|blog|user|reader|the|my|js|sign|up|[a-z]|\d+)")
#: Names of content (fixed values).
_CONTENT_NAME = re.compile(r"(?:[a-z0-9]+[-_])?(?:article|articlebody|content|post|entry|story|main)(?:[-_](?:body|content|text|main))?|markdown-body|prose")
#: Names that describe the layout round an element, whatever they mention (fixed values).
_LAYOUT_NAME = re.compile(r"(?:has|with|no|without|is|hide|show)[-_].*|layout|page")
_WORD = re.compile(r"[a-z0-9]+")

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    heading: bool
    tag: int  # 1: the nearest mark by tag is content, -1: furniture, 0: none
    name: int  # 1: the nearest name sounds like content, -1: in part like furniture, -2: wholly, 0: none


def attributes_of(source: str) -> dict[str, str]:
    """The names and values of a tag's attributes; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


@functools.lru_cache(maxsize=1 << 14)
def name_evidence(value: str) -> int:
    """What one class, id or role name sounds like: 1, 0, -1 or -2 (see ``Block``)."""
    value = value.lower()
    if _LAYOUT_NAME.fullmatch(value):
        return 0
    words = _WORD.findall(value)
    furniture = sum(_FURNITURE_WORD.fullmatch(w) is not None for w in words)
    if furniture:
        rest = sum(_NEUTRAL_WORD.fullmatch(w) is not None for w in words)
        return -2 if furniture + rest == len(words) else -1
    return 1 if _CONTENT_NAME.fullmatch(value) else 0


def place_of(tag: str, source: str, inside: tuple[int, int]) -> tuple[int, int]:
    """(tag, name) evidence inside an element, from that round it.

    Content tags begin anew: names round them say nothing of their inside, save
    readers' words (wholly furniture by name, which an article may be as well).
    """
    by_tag, by_name = inside
    if tag in ("html", "body"):
        return inside
    found = attributes_of(source) if source.strip(" /") else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return -1, by_name
    own = [name_evidence(w) for key in ("class", "id", "role") for w in found.get(key, "").split()]
    least, most = min(own, default=0), max(own, default=0)
    if tag in CONTENT_TAGS:
        if by_tag < 0:
            return inside
        readers = by_name == -2 and by_tag > 0 or any("comment" in found.get(key, "").lower() for key in ("class", "id")) and least == -2
        return 1, -2 if readers else 0
    if tag in FURNITURE_TAGS or tag == "header" and by_tag != 1:
        return -1, by_name
    if by_name == -2 or least == -2:
        return by_tag, -2
    return by_tag, most or least or by_name


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, int]]] = []  # open block elements and marked ones, with their evidence
    pieces: list[str] = []
    linked = anchors = heading = 0
    silent: str | None = None
    silent_depth = at = 0
    hidden: list[str] = []  # block elements open inside the silent one

    def end_of(tag: str) -> int | None:
        end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
        return end.end() if end else None

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, linked / words), heading > 0, *(stack[-1][1] if stack else (0, 0))))
        pieces, linked = [], 0

    while found := _MARKUP.search(page, at):  # raw text is skipped before any markup in it can match
        if silent is None and found.start() > at:
            text = html.unescape(page[at : found.start()])
            pieces.append(text)
            if anchors:
                linked += len(text.split())
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if silent is not None:
            if tag == silent:
                silent_depth += -1 if closing else not attributes.endswith("/")
                if silent_depth <= 0:
                    silent = None
                continue
            if not closing and not attributes.endswith("/") and (tag in RAW or silent == "head" and tag in ("title", "noscript", "template")):
                at = end_of(tag) or at
                continue
            if silent == "head":
                if closing or tag in HEAD_TAGS:
                    continue
            elif not closing:
                if tag in BLOCK and tag not in VOID and not attributes.endswith("/"):
                    hidden.append(tag)
                continue
            elif tag in hidden:
                while hidden.pop() != tag:
                    pass
                continue
            elif tag not in BLOCK or all(name != tag for name, _ in stack):
                continue
            silent = None  # its end tag is missing: the body begins, or a block around it ends
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                if tag in RAW:
                    at = end_of(tag) or len(page)
                else:
                    silent, silent_depth, hidden = tag, 1, []
            continue
        if tag == "br" or tag in VOID and tag not in BLOCK:
            pieces.append(" ")
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if closing else anchors + 1
            continue
        block = tag in BLOCK
        if block:
            flush()
            if tag in ("hr",):
                continue
        inside = stack[-1][1] if stack else (0, 0)
        if closing:
            if any(name == tag for name, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            anchors = 0 if block else anchors
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                heading = 0
            continue
        if block and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
            inside = stack[-1][1] if stack else (0, 0)
        place = place_of(tag, attributes, inside)
        if block or place != inside:
            if not block:
                flush()
            if not attributes.endswith("/"):
                stack.append((tag, place))
        if block:
            heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
    if silent is None and at < len(page):
        pieces.append(html.unescape(page[at:]))
    flush()
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "tag", "name", "marked")

#: The labelled pages, one a line.  +n is a block of n words of main text, -n one of n other words.
LABELLED = """
<nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-9</div><article><h1>+8</h1><p>+120<p>+60<p>+90</article><footer>-14</footer>
<nav><a>-2</a></nav><div class=ad>-25</div><article><h1>+6</h1><p>+1<p>+40<br>+3<p>+2</article><footer>-9</footer>
<header><h1>-3</h1><p>-6</header><article><h2>+5</h2><p><a>+4</a><p>+30<ul><li><a>+3</a><li>+8</ul><p>+1<p><a>+9</a></article><aside><h3>-2</h3><p>-40<p>-70</aside>
<main><h1>+3</h1><p>+55<div class=newsletter><p>-30</div><p>+45<div class=related-posts><h3>-2</h3><a>-8</a></div><p>+12</main><form><p>-20</form>
<article class=related-work><h1>+4</h1><p>+35<p>+18<div class=share-buttons><a>-1</a><a>-1</a></div><p>+70</article>
<div id=search-main><article><p>+6<p>+80<p>+3</article></div><div class=search-box><p>-4</div>
<article><p>+22<p class=alert-box-explained>+11<p>+40<div class=header-styles-described><p>+9<p>+30</div><p>+16</article>
<article><p>+50<div class=share-this-story><a>-3</a><a>-4</a></div><p>+28<div class=related-reading><ul><li><a>-7</a><li><a>-9</a></ul></div></article>
<main><p>+90<div class=promo-card-large><a>-12</a></div><p>+14<section id=comments><p>-25<p>-60<article><p>-18</article></section></main>
<div class=header>-3</div><ul class=main-menu><li>-1<li>-2</ul><div id=content><h1>+5</h1><div class=entry-content><p>+7<p>+1<p>+66</div></div><div id=site-footer>-2</div>
<div class=topbar><p>-12</div><h1>+7</h1><div class=post-content><p>+40<p>+9<p>+25</div><div class=comment-list><p>-33<p>-50</div>
<div class=notice>-2</div><div class=story><p>+6<p>+30<form><p>-3</form><div class=left_sidebar><p>-1<p>-45</div></div>
<div class=cookie-notice><p>-40</div><div class=content><p>+110<p>+70</div><div class=widget><h4>-2</h4><p>-15</div>
<div><a>-1</a> <a>-1</a></div><h1>+2</h1><p>+60<p>+40<div><a>-1</a> <a>-1</a></div>
<div><a>-2</a><a>-3</a><a>-2</a></div><h2>+6</h2><p>+70<p>+35<p>+8<p>+50<div>-5</div><div><a>-4</a></div>
<p>-4<div><a>-1</a></div><h1>+9</h1><div>+130</div><div>+80<a>+3</a></div><div><a>-10</a></div><div>-6</div><div><a>-2</a></div>
<div><a>-12</a></div><div><a>-20</a></div><div>+90</div><div>+28</div><div>+65</div><div>-4</div>
<div>-10</div><div><a>-1</a></div><h3>+3</h3><p>+38<a>+2</a><p>+20<h3>+4</h3><p>+45<div><a>-1</a></div><div>-2</div>
<div class=widget><h1>+6</h1><p>+90<p>+120<p>+70</div><div class=footer><a>-3</a></div>
<div class=page-header-and-text><h1>+5</h1><p>+75<p>+12<p>+50</div><div><a>-3</a></div>
<p>-6<a>-4</a><div>-3</div><article><p>+45</article><div>-14</div><div>-5</div>
<div>-8</div><main><p>+15<p>+100</main><div><a>-2</a></div><div>-20</div>
<div>-3</div><h1>+5</h1><div class=article-body><p>+60<p>+20</div><div>-7</div>
<h2>+3</h2><p>+5<p>+44<p>+2<p>+71
<article><p>+1<p>+3<p>+60<p>+3<p>+40<p>+2<p>+3<p>+100<p>+4<p>+3<p>+20<p>+3<h2>+1</h2><p>+3<p>+18</article>
<article><p>+3<p>+3<p>+2<p>+12<p>+3<p>+15<p>+1</article>
<article><p><a>+3</a><p><a>+12</a><p>+30<p><a>+1</a><p>+2<a>+2</a></article>
<article><h1>+9</h1><p>+75<p>+14<p>+1<p>+33<h2>+2</h2><p>+11<p>+6<p>+140<p>+17<p>+8<p>+4<p>+21<p>+2</article>
<article><p>+7<ul><li>+5<li>+9<li>+2<li>+13<li>+1</ul><p>+26<blockquote>+19</blockquote><pre>+4</pre><p>+88<table><tr><td>+1<td>+2<td>+1<tr><td>+3<td>+1</table><p>+10</article>
<main><h1>+4</h1><p>+11<p>+16<p>+5<p>+62<h3>+3</h3><p>+7<p>+23<p>+1<p>+9<p>+45<p>+12<p>+2</main>
<article><p>+10</article><aside><p>-10</aside>
<article>+1</article><footer>-1</footer>
<article><p>+5<p>+6</article>
<article>+13</article>
<main>+3</main>
<aside><h3>-2</h3><p>-30<p>-3<p>-75<p>-12</aside><article><p>+30</article><footer><p>-20<p>-3<p>-110<p>-45</footer>
<nav><p>-14<p>-2<p>-60</nav><footer><h4>-3</h4><p>-35<p>-8<p>-90</footer>
<form><p>-16<p>-50</form><menu><li>-4<li>-22</menu><header><p>-28<p>-95</header>
<article><p>+20<p>+40</article><div class=comments><p>-3<p>-70<p>-120<p>-90<p>-12</div><div class=banner>-80</div>
<div class=content><p>+20<p>+4<p>+140<p>+2<p>+17</div><div class=sidebar><p>-66<p>-100<p>-95</div><div class=promo><p>-72</div>
<div class=content><p>+12<p>+33<p>+6</div>
<div><a>-22</a></div><div><a>-35</a></div><p>+60<p>+33<p>+90<div><a>-40</a></div><div><a>-34</a></div>
<div><a>-5</a></div><h1>+7</h1><p>+45<p><a>+2</a>+80<p>+24<p>+13<p>+37<div><a>-60</a></div><div>-9</div>
<nav><p>-40</nav><h1>+5</h1><p>+60<p>+20<p>+48<footer><p>-36<p>-50</footer>
<ul><li><a>-3</a><li><a>-33</a><li><a>-4</a></ul><p>+35<p>+42<ul><li>+9<li>+14</ul><p>+33<ul><li><a>-5</a><li><a>-4</a></ul>
<div class=ad>-9</div><nav><a>-2</a><a>-3</a></nav><article><p>+30<p>+6</article><div class=ad>-30</div><div><a>-9</a></div>
<div class=banner>-14</div><div><a>-6</a></div><p>+70<p>+35<p>+90<div class=notice>-21</div><div><a>-3</a></div><div class=comments><p>-40<p><a>-6</a></div>
<title>-1</title><div>-2</div><article><h1>+4</h1><p>+9<p>+3</article><div>-6</div>
<h1>+6</h1><p>+80<p>+41<p>+66<h3>-2</h3><div><a>-8</a></div><div>-28</div><div><a>-7</a></div><div>-31</div><div><a>-9</a></div><div>-40</div><div><a>-6</a></div>
<div><a>-9</a></div><div>-26</div><div><a>-11</a></div><div>-44</div><div><a>-5</a></div><div>-22</div><div><a>-2</a></div>
<div><a>-2</a></div><p>+26<p>+48<p>+20<a>+3</a><p>+31<div><a>-4</a></div>
<p>+55<p><a>+4</a>+1<p>+29<p>+72
<div>-1</div><div>-12</div><div class=content><p>+25<p>+9</div><div>-11</div><div>-3</div>
<footer>-40</footer><form>-36</form><aside>-60<p>-45</aside>
<div id=main>+8</div>
<div class=entry><p>+3<p>+40<p>+3<p>+2<p>+25<p>+3<p>+9</div><div>-3</div>
<div class=header>-3</div><h1>+6</h1><p>+70<p>+45<div class=cookie-notice>-18</div><div class=footer><p>-9</div>
<div class=banner><p>-20</div><div>-2</div><h1>+4</h1><p>+30<p>+3<p>+55<div class=comments><p>-3<p>-30<p>-60</div>
<div class=sidebar><p>-30<p>-12</div><p>+80<p>+3<p>+90<div class=ad><p>-25</div><p>+35<div class=newsletter-signup><p>-14</div>
<p>+52
<div>+18</div><div>+33</div>
"""


def _words(found: re.Match) -> str:
    sign, count = found[1], int(found[2])
    return " ".join([sign, *["w"] * (count - 1)]) if count > 1 else sign


def labelled_rows() -> list[tuple[list[float], int]]:
    """The labelled table: a block's features, then 1 for main text."""
    rows = []
    for line in LABELLED.strip().splitlines():
        blocks = blocks_of(re.sub(r"([+-])(\d+)(?=<|$)", _words, line))
        rows += [(list(row), int(b.text[0] == "+")) for b, row in zip(blocks, features(blocks), strict=True)]
    return rows


@dataclass
class Node:
    """A split (values at most ``limit`` go left) or, with ``keep`` set, a leaf."""

    feature: int = 0
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None
    keep: bool | None = None

    def decide(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.keep is None:
            node = node.left if row[node.feature] <= node.limit else node.right
        return node.keep


def grow(rows: list[tuple[list[float], int]], depth: int = 12) -> Node:
    """CART with Gini impurity; ties go to the earlier feature and the lower limit."""
    ones, n = sum(y for _, y in rows), len(rows)
    if depth == 0 or ones in (0, n) or n < 4:
        return Node(keep=2 * ones >= n and n > 0)
    gini = lambda k, m: 2 * k * (m - k) / m if m else 0.0
    best: tuple | None = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:], strict=False):
            limit = (low + high) / 2
            left = [y for x, y in rows if x[f] <= limit]
            cost = gini(sum(left), len(left)) + gini(ones - sum(left), n - len(left))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, limit)
    if best is None or best[0] >= gini(ones, n) - 1e-12:
        return Node(keep=2 * ones >= n)
    _, f, limit = best
    return Node(f, limit, grow([r for r in rows if r[0][f] <= limit], depth - 1), grow([r for r in rows if r[0][f] > limit], depth - 1))


@functools.cache
def default_tree() -> Node:
    return grow(labelled_rows())


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    edge = Block("", 0, 0.0, False, 0, 0)
    marked = sum(b.words for b in blocks if b.name > -2 and (b.tag > 0 or b.tag == 0 and b.name > 0)) > 0
    out = []
    for k, b in enumerate(blocks):
        before, after = blocks[k - 1] if k else edge, blocks[k + 1] if k + 1 < len(blocks) else edge
        out.append((b.words, b.link_density, before.words, before.link_density, after.words, after.link_density, float(b.heading), b.tag, b.name, float(marked)))
    return out


def main_text(page: str | None, tree: Node | None = None) -> str:
    """The page's main text: kept blocks joined by a blank line."""
    if not page:
        return ""
    tree = tree or default_tree()
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if tree.decide(row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; no rows move."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    bounded_batches(pages.sparkSession)
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
