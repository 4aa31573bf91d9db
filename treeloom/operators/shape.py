"""Records (ordered fields of raw values) as XML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.functions.text import is_dropped_field, safe_tag, strip, xml_escaped
from treeloom.functions.wikitext import clean_values, items_of_values

#: Numbered pairs of fields that make groups: group, member, label and value with the
#: fields' prefixes. Numbers go from 1 on.
GROUPS = (("established", "event", ("label", "established_event"), ("date", "established_date")), ("leaders", "leader", ("title", "leader_title"), ("name", "leader_name")))
NUMBER = "([1-9][0-9]*)$"


def exploded(records: DataFrame, fields: str = "fields", doc_id: str = "doc_id") -> DataFrame:
    """A row for each field: ``doc_id``, ``pos``, ``key``, ``value``."""
    return records.select(F.col(doc_id).alias("doc_id"), F.posexplode(fields).alias("pos", "x")).select("doc_id", "pos", "x.key", "x.value")


def aliased(fields: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Keys by their canonical names; of fields that then share one, the first stays, as
    the first place and value in order."""
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)) if aliases else None
    key = F.coalesce(F.try_element_at(names, F.col("key")), "key") if aliases else F.col("key")
    window = Window.partitionBy("doc_id", "key").orderBy("pos")
    return fields.withColumn("key", key).withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def numbered_pairs(fields: DataFrame, label_prefix: str, value_prefix: str) -> DataFrame:
    """``doc_id``, ``number``, ``label``, ``value`` of each pair of which one side is not
    blank; a missing side is empty. One aggregation, no join."""
    n = F.regexp_extract("key", f"^(?:{label_prefix}|{value_prefix}){NUMBER}", 1)
    sided = fields.withColumn("number", n.try_cast("decimal(38,0)")).where(F.col("number").isNotNull())
    side = lambda p: F.coalesce(F.max(F.when(F.col("key").startswith(p), strip("value"))), F.lit(""))
    return sided.groupBy("doc_id", "number").agg(side(label_prefix).alias("label"), side(value_prefix).alias("value")).where("label <> '' OR value <> ''")


def _renamed(fields: Column, aliases: dict[str, str]) -> Column:
    """An array of fields with keys by their canonical names."""
    if not aliases:
        return fields
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.transform(fields, lambda x: F.struct(F.coalesce(F.try_element_at(names, x["key"]), x["key"]).alias("key"), x["value"].alias("value")))


def _pairs(fields: Column, label_prefix: str, value_prefix: str) -> Column:
    """:func:`numbered_pairs` on an array of fields, in order of numbers."""
    found = F.array_distinct(F.transform(fields, lambda x: F.regexp_extract(x["key"], f"^(?:{label_prefix}|{value_prefix}){NUMBER}", 1)))
    ordered = F.sort_array(F.transform(F.filter(found, lambda n: n != ""), lambda n: F.struct(F.length(n).alias("digits"), n.alias("number"))))
    value = lambda key: F.coalesce(strip(F.get(F.filter(fields, lambda x: x["key"] == key), 0)["value"]), F.lit(""))
    sides = F.transform(ordered, lambda s: F.struct(s["number"].alias("number"), value(F.concat(F.lit(label_prefix), s["number"])).alias("label"), value(F.concat(F.lit(value_prefix), s["number"])).alias("value")))
    return F.filter(sides, lambda p: (p["label"] != "") | (p["value"] != ""))


def _element(tag: Column, content: Column) -> Column:
    return F.concat(F.lit("<"), tag, F.lit(">"), content, F.lit("</"), tag, F.lit(">"))


def build_xml(records: DataFrame, fields: str = "fields", doc_id: str = "doc_id", name: str = "name", *, strategy: str = "single_node", aliases: dict[str, str] | None = None, reference_suffix: bool = True) -> DataFrame:
    """``doc_id`` and ``xml`` of each record.

    Plain fields come first, in order, cleaned, without blank ones and those of layout;
    then the groups of numbered pairs. With ``token_nodes`` a value of several items has an
    ``item`` for each. Members of groups stay even where cleaning leaves nothing of them.
    A record is one row, so ids may be null or repeat; null fields are none, a null name is
    empty, and fields without a key are left out.
    """
    kind = "array<struct<key:string,value:string>>"
    rows = records.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.coalesce(F.filter(F.col(fields).cast(kind), lambda x: x["key"].isNotNull()), F.array().cast(kind)).alias("f"))
    rows = rows.withColumn("f", _renamed(F.col("f"), aliases or {}))
    rows = rows.withColumn("f", F.filter("f", lambda x, i: F.array_position(F.col("f")["key"], x["key"]) == i + 1))
    groups = [f"g{k}" for k in range(len(GROUPS))]
    rows = rows.withColumns({g: _pairs(F.col("f"), label, value) for g, (_, _, (_, label), (_, value)) in zip(groups, GROUPS)})
    keys = lambda g, prefix: F.transform(F.col(g)["number"], lambda n: F.concat(F.lit(prefix), n))
    rows = rows.withColumn("taken", F.concat(*(keys(g, prefix) for g, (_, _, *sides) in zip(groups, GROUPS) for _, prefix in sides)))
    rows = rows.withColumn("f", F.filter("f", lambda x: ~F.array_contains("taken", x["key"]) & ~is_dropped_field(x["key"], reference_suffix=reference_suffix)))
    raw = F.transform("f", lambda x: F.coalesce(x["value"], F.lit("")))
    members = F.concat(*(F.col(g)[side] for g in groups for side in ("label", "value")))
    if strategy == "token_nodes":
        rows = rows.withColumns({"items": items_of_values(raw), "clean": clean_values(members)})
        several = lambda xs: F.array_join(F.transform(xs, lambda x: _element(F.lit("item"), xml_escaped(x))), "")
        content = lambda xs: F.when(F.size(xs) > 1, several(xs)).otherwise(xml_escaped(F.get(xs, 0)))
        plain = F.zip_with("f", "items", lambda x, xs: F.when(F.size(xs) > 0, _element(safe_tag(x["key"]), content(xs))))
        before = F.lit(0)
    else:
        # One pass through Python cleans plain fields and members of groups.
        rows = rows.withColumn("clean", clean_values(F.concat(raw, members)))
        before = F.size("f")
        plain = F.zip_with("f", F.slice("clean", F.lit(1), before), lambda x, v: F.when(v != "", _element(safe_tag(x["key"]), xml_escaped(v))))
    parts = [F.array_join(plain, "")]
    for g, (group, member, (label_tag, _), (value_tag, _)) in zip(groups, GROUPS):
        made = _members(g, before, member, label_tag, value_tag)
        parts.append(F.when(F.size(g) > 0, _element(F.lit(group), F.array_join(made, ""))).otherwise(""))
        before = before + 2 * F.size(g)
    return rows.select("doc_id", F.concat(F.lit('<country name="'), xml_escaped("name"), F.lit('">'), *parts, F.lit("</country>")).alias("xml"))


def _members(pairs: str, before: Column, member: str, label_tag: str, value_tag: str) -> Column:
    """The elements of a group's pairs, whose clean labels stand in ``clean`` from ``before``
    on, and their values after them."""
    side = lambda tag, raw, at: F.when(raw != "", _element(F.lit(tag), xml_escaped(F.get(F.col("clean"), at)))).otherwise("")
    return F.transform(F.col(pairs), lambda p, i: _element(F.lit(member), F.concat(side(label_tag, p["label"], before + i), side(value_tag, p["value"], before + F.size(pairs) + i))))
