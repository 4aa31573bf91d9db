"""Column functions over text. Patterns follow Unicode, so ``(?U)`` is set throughout; the
four separators U+001C to U+001F count as white space as well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_whitespace(x: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)[\s\x1c-\x1f]+", " "))


def strip_comments(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), r"(?s)<!--.*?-->", "")


def strip_refs(x: str | Column) -> Column:
    """Without reference tags: empty ones, pairs with their content, stray ends."""
    for pattern in (r"(?i)<ref[^>]*/>", r"(?is)<ref[^>]*>.*?</ref>", r"(?i)</ref>"):
        x = F.regexp_replace(_col(x), pattern, "")
    return x


def strip_tags(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), r"<[^>]+/?>", "")


def strip_inline_notes(x: str | Column) -> Column:
    """Without note arguments of lists, up to the next list line."""
    return F.regexp_replace(_col(x), r"(?sU)\|efn\|.*?(?=\n\s*\|)", "")


def strip_tree_lists(x: str | Column) -> Column:
    return F.regexp_replace(_col(x), r"(?s)\{\{[Tt]ree list\}\}.*?\{\{[Tt]ree list/end\}\}", "")


def unwrap_links(x: str | Column) -> Column:
    """Wiki links as their shown text."""
    return F.regexp_replace(F.regexp_replace(_col(x), r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]]+)\]\]", "$1")


def is_bullet_block(x: str | Column) -> Column:
    return F.regexp_like(_col(x), F.lit(r"(?mU)^\s*\*"))


def is_junk_item(x: str | Column) -> Column:
    """Whether a list item is template noise."""
    s = strip(x)
    exact = F.lower(s).isin("", "efn", "ref", "tree list", "tree list/end", "/ref")
    return exact | s.rlike(r"(?iU)^(</?\s*ref\b|name\s*=|group\s*=|url|doi\s*=|jstor\s*=)")


def tokenize(x: str | Column) -> Column:
    """The runs of ASCII letters and digits."""
    return F.regexp_extract_all(_col(x), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def safe_tag(x: str | Column) -> Column:
    """A name as an XML tag."""
    tag = F.regexp_replace(_col(x), r"[^a-zA-Z0-9_\-.]", "_")
    return F.when(tag == "", "_field").when(tag.rlike("^[0-9]"), F.concat(F.lit("_"), tag)).otherwise(tag)


#: Fields of layout, or of citations, that are no data.
DROPPED_FIELDS = (
    r"rowclass\d*$", r"label\d*$", r"data\d*$", "titlestyle$", "bodystyle$", "subbox$", "liststyle$", "item_style$", "map_width$", "alt_", "image_", "coa_size$", r"area_label\d*$", "area_footnote$", "area_link$", r"area_data\d*$",
    "today$", "last$", "date$", "title$", "journal$", "script-journal$", "volume$", "pages$", "url$", "url-status$", "archiveurl$", "archivedate$", "publisher$",
)


def is_dropped_field(x: str | Column, *, reference_suffix: bool = True) -> Column:
    """Whether a field is left out. ``reference_suffix`` also drops names that end in
    ``_ref``; without it only the name ``_ref`` itself is dropped."""
    names = _col(x).rlike("(?U)^(" + "|".join(DROPPED_FIELDS) + ")")
    return names | _col(x).rlike("_ref$" if reference_suffix else "^_ref$")


def parse_number(x: str | Column) -> Column:
    """What is left of digits, points, commas and signs, as a double; null if no number.

    Words of scale are lost, and the digits of a date run together.
    """
    kept = F.replace(F.regexp_replace(_col(x), r"(?U)[^\d.,\-]", ""), F.lit(","), F.lit(""))
    return F.when(kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def magnitude(before: str | Column, after: str | Column) -> Column:
    """A struct of both numbers, their ratio, difference and direction; null unless both are
    numbers. From 0 the ratio is infinite; of 0 and 0 it is 1, with no difference."""
    a, b = parse_number(before), parse_number(after)
    ratio = F.when((a == 0) & (b == 0), 1.0).when(a == 0, F.lit(float("inf"))).otherwise(F.round(F.try_divide(b, a), 3))
    exact = F.when((a == 0) & (b == 0), 1.0).when(a == 0, F.lit(float("inf"))).otherwise(F.try_divide(b, a))
    direction = F.when(exact > 1, "increase").when(exact < 1, "decrease").otherwise("same")
    both = F.struct(a.alias("from_num"), b.alias("to_num"), ratio.alias("ratio"), F.when((a != 0) | (b != 0), F.round(F.abs(b - a), 3)).alias("abs_diff"), direction.alias("direction"))
    return F.when(a.isNotNull() & b.isNotNull(), both)


def xml_escaped(x: str | Column, *, quotes: bool = True) -> Column:
    x = F.replace(F.replace(F.replace(_col(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(x, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else x
