"""Main text of web pages by tag-path ratios (operator 9).

A page is read once into text blocks, each with the path of tags from the root to it.
Length and punctuation without links are summed for each path. A path's ratios of text to
blocks and of punctuation to blocks are smoothed over its neighbours below the same
element and fused into one score; paths above a threshold, set by the page's own scores,
are content. The element that holds most of the content is the article, and what stands
in it of other paths goes if it is links or is named as something else.

Names (a class, an id) never decide alone: an element on the path that is named as an
advert, a comment and so on lowers its score, and the threshold follows the scores. Only
what HTML itself says to be no article, by tag or role, is left out before.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from math import sqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import string_column

# Fixed values of the HTML standard.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements whose content is not markup, or is not shown.
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"})
TEXTUAL = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary"})
CONTAINERS = frozenset(
    {"address", "article", "aside", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figure", "footer", "form", "frameset", "head", "header", "hgroup", "html", "legend", "main", "menu", "nav", "ol", "optgroup", "option", "search", "section", "table", "tbody", "tfoot", "thead", "tr", "ul"}
)
BLOCKS = TEXTUAL | CONTAINERS
IN_HEAD = frozenset({"base", "basefont", "bgsound", "head", "html", "link", "meta", "noscript", "script", "style", "template", "title"})
CELLS, ROWS, ITEMS = ("td", "th"), ("tr", "td", "th"), ("dt", "dd")
#: Open elements that a start tag ends; a block ends a paragraph besides.
ENDS = {"li": ("li",), "dt": ITEMS, "dd": ITEMS, "td": CELLS, "th": CELLS, "tr": ROWS, "option": ("option",), "optgroup": ("option", "optgroup")} | {x: (*ROWS, "thead", "tbody", "tfoot") for x in ("thead", "tbody", "tfoot")}
IN_PARAGRAPH = frozenset({"option", "optgroup", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot"})
#: Elements past which an implied end, or the end tag of no block, does not look.
SCOPES = frozenset({"html", "body", "table", "td", "th", "ul", "ol", "dl", "article", "section", "main", "aside", "nav", "header", "footer", "form", "div"})
#: Elements and roles that are never part of an article; some of them stand inside a line.
OUTSIDE = frozenset({"nav", "aside", "footer", "menu", "dialog", "search", "datalist", "head", "button", "select", "object", "svg", "canvas", "audio", "video"})
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"})

#: Words that name what is no article, and words that may stand beside them in a name.
NAMING = frozenset(
    {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "share", "sharing", "sidebar", "social", "sponsored", "subscribe"}
)
BESIDE = frozenset({"area", "bar", "block", "bottom", "box", "container", "global", "item", "left", "links", "list", "main", "page", "right", "section", "site", "slot", "top", "unit", "wrap", "wrapper"})
#: Words that name an article's own heading, if they stand in one.
HEADING = frozenset({"header", "banner"})

ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*)))?")
#: A comment, a declaration, a tag with its attributes, or text; each ends at the latest with
#: the page, so no part of it is read twice.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+))?+)*+)(?:>|(\Z))"
    r"|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
MARKS = re.compile(r"[.,;:!?…。，、！？；：]")
SPACE = re.compile(r"\s+")

#: What a named element, and text that stands bare in a container, leave of a path's score.
NAMED, BARE = 0.002, 0.3
#: Of the page's usual score: the least of a content path.
THRESHOLD = 0.02
#: Part of the content that the article's element holds.
SHARE = 0.7


class Path(NamedTuple):
    parent: int
    tag: str
    #: Elements on it that are named as no article, and whether one is an article or main.
    named: int
    article: bool


class Block(NamedTuple):
    text: str
    path: int
    element: int
    link_chars: int


class Page(NamedTuple):
    """Blocks in order; paths by number, a parent before its children; each element's parent
    and path, by number as well. Number 0 stands above all."""

    blocks: list[Block]
    paths: list[Path]
    parents: list[int]
    element_paths: list[int]


def _said(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is outside, and whether it is named as no article."""
    outside, named = tag in OUTSIDE or tag == "header" and not in_article, tag == "form"
    if not outside and ("=" in attributes or "hidden" in attributes):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "role" and value.lower() == "form":
                named = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False
            elif name in ("class", "id") and tag in BLOCKS and tag not in ("html", "body", "main", "p"):
                for word in value.split():
                    parts = {x.lower() for x in NAME_PARTS.findall(word)}
                    found = parts & NAMING - (HEADING if in_article else frozenset())
                    named = named or bool(found) and parts <= NAMING | BESIDE
    return outside, named


def read(html: str) -> Page:
    """A page's text blocks, white space inside each turned into one space.

    Tags that the standard lets authors leave out are implied; unclosed elements end with
    the element around them; a tag that never ends takes the rest of the page. The text of
    scripts, styles and comments is not read, nor that of elements outside. A header inside
    an article is its own heading, any other is outside. Time and memory grow with the
    length of the page, whatever is in it.
    """
    out: list[Block] = []
    paths, known = [Path(-1, "", 0, False)], {}
    parents, element_paths = [-1], [0]
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, element, path, outside
    opened: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each tag
    scopes = [0]
    unended: set[str] = set()
    text: list[str] = []
    link = pos = 0
    length = len(html)

    def flush() -> None:
        nonlocal link
        if text:
            found = SPACE.sub(" ", "".join(text)).strip()
            if found:
                out.append(Block(found, stack[-1][2], stack[-1][1], min(link, len(found))))
            text.clear()
        link = 0

    def close(to: int) -> None:
        """Ends the open elements from place ``to`` on, and their block if one is a block."""
        if any(x in BLOCKS for x, _, _, _ in stack[to:]):
            flush()
        while len(stack) > to:
            opened[stack.pop()[0]].pop()
        while scopes[-1] >= to:
            scopes.pop()

    def reachable(tag: str) -> int:
        """The place of the last open element of that tag if it is in scope, else 0."""
        at = opened[tag][-1] if opened[tag] else 0
        return at if at >= scopes[-1] else 0

    while pos < length:
        m = TOKEN.match(html, pos)
        pos = m.end()
        tag, piece = m[2], m[0]
        if tag is None:
            if piece[0] == "<" and len(piece) > 1:
                continue
            if opened["head"] and not piece.isspace():
                close(opened["head"][0])
            if not stack[-1][3]:
                text.append(unescape(piece))
                link += len(text[-1]) * bool(opened["a"])
            continue
        if m[4] is not None:
            break
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                text.append(" ")
            elif tag == "p" and not opened["p"]:
                flush()
            elif opened[tag]:
                at = opened[tag][-1] if tag in BLOCKS else reachable(tag)
                if at:
                    close(at)
            continue
        if opened["head"] and tag not in IN_HEAD:
            close(opened["head"][0])
        if tag in RAW:
            end = None if tag in unended else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            if end is None:
                unended.add(tag)
            if end or tag not in ("noscript", "template"):
                pos = end.end() if end else length
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                text.append(" ")
            continue
        ended = ENDS.get(tag, ()) + (("p",) if tag in BLOCKS and tag not in IN_PARAGRAPH else ())
        while ended and (at := max(map(reachable, ended))):
            close(at)
        if tag in BLOCKS:
            flush()
        if m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        _, element, path, outside = stack[-1]
        if not outside:
            outside, named = _said(tag, m[3], paths[path].article)
            if not outside and tag in BLOCKS:
                above = paths[path]
                made = Path(path, tag, above.named + named, above.article or tag in ("article", "main"))
                if made not in known:
                    known[made] = len(paths)
                    paths.append(made)
                path = known[made]
        parents.append(element)
        element_paths.append(path)
        opened[tag].append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append((tag, len(parents) - 1, path, outside))
    flush()
    return Page(out, paths, parents, element_paths)


def path_scores(page: Page) -> dict[int, float]:
    """The fused ratio of each path that has blocks: a geometric mean, so that a text twice as
    long weighs about twice as much.

    Text and marks a block, both without links, are averaged over the paths next to it (by
    first appearance) whose last element is below the same path and named alike.
    """
    blocks, chars, marks = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in page.blocks:
        blocks[b.path] += 1
        chars[b.path] += len(b.text) - b.link_chars
        marks[b.path] += len(MARKS.findall(b.text)) if b.link_chars < len(b.text) else 0
    family = defaultdict(list)
    for x in blocks:
        family[page.paths[x].parent, page.paths[x].named].append(x)
    out = {}
    for beside in family.values():
        for k, x in enumerate(beside):
            near = beside[max(0, k - 1) : k + 2]
            text = sum(chars[y] / blocks[y] for y in near) / len(near)
            points = sum(marks[y] / blocks[y] for y in near) / len(near)
            out[x] = sqrt(text * (1 + points)) * NAMED ** page.paths[x].named * (1 if page.paths[x].tag in TEXTUAL else BARE)
    return out


def content(page: Page, scores: dict[int, float]) -> tuple[set[int], float]:
    """The paths above the threshold, and the page's usual score: the mean that weighs each
    character by its path's score."""
    weight = defaultdict(float)
    for b in page.blocks:
        weight[b.path] += len(b.text) - b.link_chars
    total = sum(scores[x] * w for x, w in weight.items())
    usual = sum(scores[x] ** 2 * w for x, w in weight.items()) / total if total else 0.0
    return {x for x, s in scores.items() if s >= THRESHOLD * usual and weight[x] > 0} or set(scores), usual


def article_element(page: Page, chosen: set[int], scores: dict[int, float], usual: float) -> tuple[int, int]:
    """The innermost element that holds most of the content, each character weighing its
    path's score up to the usual one: its number and the last number in it.

    It is no paragraph or the like, and it reaches as far out as paragraphs in the paths of
    those in it stand.
    """
    mass, last = [0.0] * len(page.parents), list(range(len(page.parents)))
    for b in page.blocks:
        if b.path in chosen:
            mass[b.element] += (len(b.text) - b.link_chars) * min(1.0, scores[b.path] / usual if usual else 1.0)
    # Elements are numbered by their start tags, so those in one are a range of numbers.
    for n in range(len(mass) - 1, 0, -1):
        mass[page.parents[n]] += mass[n]
        last[page.parents[n]] = max(last[page.parents[n]], last[n])
    at = max((n for n in range(len(mass)) if mass[n] >= SHARE * mass[0]), default=0) if mass[0] else 0
    while at and page.paths[page.element_paths[at]].tag in TEXTUAL:
        at = page.parents[at]
    reach: dict[int, tuple[int, int]] = {}
    for b in page.blocks:
        if b.path in chosen and page.paths[b.path].tag in TEXTUAL:
            low, high = reach.get(b.path, (b.element, b.element))
            reach[b.path] = (min(low, b.element), max(high, b.element))
    places = sorted((b.element, b.path) for b in page.blocks if b.path in reach)
    low, high = at, last[at]
    begin = end = bisect_left(places, (at, -1))
    while at:
        while end < len(places) and places[end][0] <= last[at]:
            low, high = min(low, reach[places[end][1]][0]), max(high, reach[places[end][1]][1])
            end += 1
        while begin and places[begin - 1][0] >= at:
            begin -= 1
            low, high = min(low, reach[places[begin][1]][0]), max(high, reach[places[begin][1]][1])
        if at <= low and high <= last[at]:
            break
        at = page.parents[at]
    return at, last[at]


def main_text(html: str | None) -> str:
    """The article of a page: its blocks joined by two line ends; empty if there are none.

    If ``article`` or ``main`` elements hold a third of the content, they are the article.
    In it, blocks of paths below the threshold go if half of them are links, or if they
    are named as something else more than the article itself is.
    """
    page = read(html or "")
    if not page.blocks:
        return ""
    scores = path_scores(page)
    chosen, usual = content(page, scores)
    weight = lambda b: (len(b.text) - b.link_chars) * min(1.0, scores[b.path] / usual if usual else 1.0) * (b.path in chosen)
    inside = [b for b in page.blocks if page.paths[b.path].article]
    if not inside or 3 * sum(map(weight, inside)) < sum(map(weight, page.blocks)):
        first, last = article_element(page, chosen, scores, usual)
        inside = [b for b in page.blocks if first <= b.element <= last]
    least = min((page.paths[b.path].named for b in inside if b.path in chosen), default=0)
    kept = [b for b in inside if b.path in chosen or 2 * b.link_chars < len(b.text) and page.paths[b.path].named <= least]
    return "\n\n".join(b.text for b in kept)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", *keep: str) -> DataFrame:
    """``text`` and ``n_chars`` (code points) of each page's whole html, with kept columns.

    Null and empty pages, and pages without an article, have an empty text. A row comes
    out for each row that goes in, equal ones included; columns not named are not read.
    """
    rows = df.select(F.col(id_col), *keep, F.col(html_col).cast("string").alias("html"))
    out = rows.select(id_col, *keep, F.col("html").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in string_column(batch, "html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1 + len(keep))), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], names=[f.name for f in out.fields])

    return rows.mapInArrow(run, out)


def op9(pages: DataFrame) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(pages, "page_id", "html", "url")
