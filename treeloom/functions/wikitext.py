"""Cleaning of wikitext values.

Balanced braces are not regular, so values that have some are cleaned in Python, in Arrow
batches. All of it rests on one scan: the places of double braces, and where the pair
opened at a place closes. Other values only need the regular stages, which are column
functions of :mod:`treeloom.functions.text`, and never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions import text as X

# The marks, templates and tags that values are cleaned of.

BRACES = re.compile(r"\{\{|\}\}")
MARKS = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")
COMMENT = re.compile(r"<!--.*?-->", re.S)
REFS = (re.compile(r"<ref[^>]*/>", re.I), re.compile(r"<ref[^>]*>.*?</ref>", re.S | re.I), re.compile(r"</ref>", re.I))
TAG = re.compile(r"<[^>]+/?>")
CITE = re.compile(r"\{\{cite[_ ]?\w*(?:\s*\||\s*\}\})", re.I)
NOTE = re.compile(r"\{\{efn(?:\s*\||\s*\}\})", re.I)
INLINE_NOTE = re.compile(r"\|efn\|.*?(?=\n\s*\|)", re.S)
TREE_LIST = re.compile(r"\{\{[Tt]ree list\}\}.*?\{\{[Tt]ree list/end\}\}", re.S)
LIST = re.compile(r"\{\{(?:unbulleted list|plainlist|ubl|hlist)\b", re.I)
LIST_START = re.compile(r"\{\{(?:unbulleted list|plainlist|ubl|hlist)\s*\|", re.I)
LINKS = ((re.compile(r"\[\[[^|\]]+\|([^\]]+)\]\]"), r"\1"), (re.compile(r"\[\[([^\]]+)\]\]"), r"\1"))
BULLET = re.compile(r"^\s*\*", re.M)
BULLETS = re.compile(r"^\s*\*+\s*")
SPACE = re.compile(r"\s+")
#: List items that are noise, whole or by how they begin.
JUNK = frozenset({"", "efn", "ref", "tree list", "tree list/end", "/ref"})
JUNK_START = re.compile(r"</?\s*ref\b|name\s*=|group\s*=|url|doi\s*=|jstor\s*=", re.I)


def closing(text: str, start: int) -> int:
    """Where the template that opens at ``start`` ends, -1 if nowhere."""
    depth = 0
    for m in BRACES.finditer(text, start):
        depth += 1 if m[0] == "{{" else -1
        if depth == 0:
            return m.end()
    return -1


def without_named(text: str, name: re.Pattern) -> str:
    """Without the templates whose start fits ``name``; an unbalanced one ends the search.

    Of templates inside each other the outer goes; what then meets may be one again.
    """
    while True:
        kept, at = [], 0
        for m in name.finditer(text):
            if m.start() >= at:
                end = closing(text, m.start())
                if end < 0:
                    break
                kept.append(text[at : m.start()])
                at = end
        if not kept:
            return text
        text = "".join([*kept, text[at:]])


def without_templates(text: str) -> str:
    """What stands outside all templates. A stray end hides what follows, up to a start."""
    while "{{" in text:
        depth, at, kept = 0, 0, []
        for m in BRACES.finditer(text):
            if depth == 0:
                kept.append(text[at : m.start()])
            depth += 1 if m[0] == "{{" else -1
            at = m.end()
        text = "".join(kept) + (text[at:] if depth == 0 else "")
    return text


def arguments(body: str) -> list[str]:
    """Split at the bars outside of templates and links."""
    out, at, braces, brackets = [], 0, 0, 0
    for m in MARKS.finditer(body):
        if m[0] == "|":
            if braces == 0 and brackets == 0:
                out.append(body[at : m.start()])
                at = m.end()
        elif m[0] in ("{{", "}}"):
            braces += 1 if m[0] == "{{" else -1
        else:
            brackets += 1 if m[0] == "[[" else -1
    return [*out, body[at:]]


def template_body(template: str) -> str:
    """What follows the first bar of a whole template; empty if it has none."""
    return template[2:-2].partition("|")[2]


def is_junk(item: str) -> bool:
    item = item.strip()
    return item.lower() in JUNK or bool(JUNK_START.match(item))


def _without_refs(text: str) -> str:
    text = COMMENT.sub("", text)
    for pattern in REFS:
        text = pattern.sub("", text)
    return without_named(without_named(text, CITE), NOTE)


def _plain(text: str) -> str:
    for pattern, shown in LINKS:
        text = pattern.sub(shown, text)
    return without_templates(TAG.sub("", text))


def clean_item(text: str) -> str:
    return SPACE.sub(" ", BULLETS.sub("", _plain(_without_refs(text)))).strip()


def _items(body: str) -> Iterator[str]:
    """The clean items of a list template's body; bullet blocks give one for each line."""
    for item in arguments(body):
        if is_junk(item):
            continue
        lines = [BULLETS.sub("", x).strip() for x in item.splitlines()] if BULLET.search(item) else [item]
        yield from filter(None, (clean_item(x) for x in lines if x))


def _lists_expanded(text: str) -> str:
    """List templates as their items, joined by commas; those inside others go with them."""
    out, at = [], 0
    for m in LIST.finditer(text):
        if m.start() < at:
            continue
        end = closing(text, m.start())
        if end < 0:
            break
        out += [text[at : m.start()], ", ".join(_items(template_body(text[m.start() : end])))]
        at = end
    return "".join([*out, text[at:]])


def _prepared(raw: str) -> str:
    return TREE_LIST.sub("", INLINE_NOTE.sub("", _without_refs(raw)))


def clean(raw: str | None) -> str | None:
    """A value as plain text; null stays null."""
    return None if raw is None else SPACE.sub(" ", _plain(_lists_expanded(_prepared(raw)))).strip()


def list_items(raw: str | None) -> list[str] | None:
    """A value as its items: those of a list template, else the value; none if empty."""
    if raw is None:
        return None
    text = _prepared(raw)
    start = text.strip()
    if LIST_START.match(start) and (end := closing(start, 0)) >= 0:
        return list(_items(template_body(start[:end])))
    return [x for x in (clean_item(text),) if x]


def _mapped(f: Callable, kind: T.DataType, values: Column) -> Column:
    """``f`` of each string of an array of strings, null where it is null."""

    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()]).astype(np.int32)
        made = pa.array([None if x is None else f(x) for x in lists.flatten().to_pylist()], pa.string() if kind == T.StringType() else pa.list_(pa.string()))
        return pa.ListArray.from_arrays(pa.array(ends), made)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(kind))(values)


def _regular(raw: Column) -> tuple[Column, Column]:
    """A value without braces as plain text, and whether it has braces after all: as it is,
    or where something between them goes."""
    without_refs = X.strip_refs(X.strip_comments(raw))
    plain = X.strip_tags(X.unwrap_links(X.strip_inline_notes(without_refs)))
    return plain, raw.contains("{{") | without_refs.contains("{{") | plain.contains("{{")


def _routed(values: Column, f: Callable, kind: T.DataType, plain: Callable[[Column], Column]) -> Column:
    """Values with braces by ``f`` in Python, others by ``plain``; null stays null."""
    hard = F.transform(values, lambda v: F.when(_regular(v)[1], v))
    return F.zip_with(_mapped(f, kind, hard), values, lambda made, v: F.coalesce(made, plain(_regular(v)[0])))


def clean_values(values: str | Column) -> Column:
    """Each value of an array as plain text."""
    return _routed(F.col(values) if isinstance(values, str) else values, clean, T.StringType(), X.normalise_whitespace)


def items_of_values(values: str | Column) -> Column:
    """Each value of an array as its items."""
    item = lambda plain: X.normalise_whitespace(F.regexp_replace(plain, r"(?U)^[\s\x1c-\x1f]*\*+[\s\x1c-\x1f]*", ""))
    plain = lambda v: F.when(v.isNotNull(), F.filter(F.array(item(v)), lambda x: x != ""))
    return _routed(F.col(values) if isinstance(values, str) else values, list_items, T.ArrayType(T.StringType()), plain)


def clean_value(x: str | Column) -> Column:
    return F.get(clean_values(F.array(x)), 0)


def extract_list_items(x: str | Column) -> Column:
    return F.get(items_of_values(F.array(x)), 0)
