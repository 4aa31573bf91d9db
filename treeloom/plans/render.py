"""Trees, scripts and comparisons as text, XML, wikitext, HTML and Markdown.

What is a list of operations is rendered by expressions. What follows the shape of a tree
is rendered a tree at a time, in Arrow batches.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import datetime
from html import escape
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import xml_escaped
from treeloom.model import ELEMENT, LEAF
from treeloom.operators.distance import similarity
from treeloom.operators.semantic import category

DIFF_NAMESPACE = "urn:idpa:diff:1.0"


def _children(nodes: list[dict]) -> dict[int | None, list[dict]]:
    out: dict[int | None, list[dict]] = {}
    for x in sorted(nodes, key=lambda x: x["pre"]):
        out.setdefault(x["parent_id"], []).append(x)
    return out


def ascii_tree(nodes: list[dict], most: int = 80) -> str:
    """The tree with lines to its branches; long labels are cut and leaves are marked."""
    children = _children(nodes)
    root = children[None][0]
    lines = [f"{root['label']}  ({len(nodes)} nodes)"]
    todo = [(x, "", k == 0) for k, x in enumerate(reversed(children.get(root["node_id"], [])))]
    while todo:
        x, lead, last = todo.pop()
        label = x["label"] if len(x["label"]) <= most else x["label"][: most - 3] + "..."
        lines.append(f"{lead}{'└── ' if last else '├── '}{label}{'  [leaf]' if x['node_type'] == LEAF else ''}")
        todo += [(y, lead + ("    " if last else "│   "), k == 0) for k, y in enumerate(reversed(children.get(x["node_id"], [])))]
    return "\n".join(lines)


def xml_tree(nodes: list[dict], pretty: bool = True) -> str:
    """The tree as XML. Leaves that were attributes are attributes again; other leaves are
    their parent's text, joined by spaces. A label that can't be a tag is made one."""
    children = _children(nodes)
    made: dict[int, ET.Element] = {}
    for x in sorted(nodes, key=lambda x: x["pre"]):
        if x["node_type"] != ELEMENT:
            continue
        element = made[x["node_id"]] = ET.Element("".join(c if c.isalnum() or c in "_-." else "_" for c in x["label"]) or "_")
        if element.tag[0].isdigit() or element.tag[0] in "-.":
            element.tag = "_" + element.tag
        for y in children.get(x["node_id"], []):
            if y["node_type"] == LEAF and y["attribute"]:
                element.set(*y["label"].split("=", 1))
        element.text = " ".join(y["label"] for y in children.get(x["node_id"], []) if y["node_type"] == LEAF and not y["attribute"]) or None
        if x["parent_id"] in made:
            made[x["parent_id"]].append(element)
    text = ET.tostring(made[children[None][0]["node_id"]], encoding="unicode")
    return minidom.parseString(text).toprettyxml(indent="  ") if pretty else text


class _Record:
    """A tree as a record: the fields below its root and the texts in them."""

    def __init__(self, nodes: list[dict]):
        self.children = _children(nodes)
        self.fields = [x for x in self.children.get(self.children[None][0]["node_id"], []) if x["node_type"] == ELEMENT]

    def below(self, x: dict | None) -> list[dict]:
        return self.children.get(x["node_id"], []) if x else []

    def text(self, x: dict | None) -> str:
        if x is None or x["node_type"] == LEAF:
            return x["label"] if x else ""
        return " ".join(filter(None, map(self.text, self.below(x))))

    def items(self, x: dict) -> list[str]:
        return [self.text(y) for y in self.below(x) if y["label"] == "item"]

    def pairs(self, x: dict, first: str, second: str) -> list[tuple[str | None, str | None]]:
        named = lambda m, label: next((self.text(y) for y in self.below(m) if y["label"] == label), None)
        return [(named(m, first), named(m, second)) for m in self.below(x)]


def wikitext(nodes: list[dict]) -> str:
    """The record as an infobox; groups are numbered pairs again, items a list template."""
    record, lines = _Record(nodes), ["{{Infobox country"]
    for x in record.fields:
        if x["label"] == "established":
            lines.append("| established_events =")
            for i, (event, date) in enumerate(record.pairs(x, "label", "date"), 1):
                lines += [f"| established_event{i} = {event}"] * bool(event) + [f"| established_date{i} = {date}"] * bool(date)
        elif x["label"] == "leaders":
            for i, (title, name) in enumerate(record.pairs(x, "title", "name"), 1):
                lines += [f"| leader_title{i} = {title}"] * (title is not None) + [f"| leader_name{i} = {name}"] * (name is not None)
        elif items := record.items(x):
            lines.append(f"| {x['label']} = {{{{unbulleted list|{'|'.join(items)}}}}}")
        else:
            lines.append(f"| {x['label']} = {record.text(x)}")
    return "\n".join([*lines, "}}"])


# The sections of a record's page, their fields, and how fields are called.
SECTIONS = [
    ("", ("conventional_long_name", "common_name", "native_name", "national_motto", "national_anthem", "map_caption")),
    ("", ("capital", "largest_city", "official_languages", "languages", "languages_type", "languages2", "languages2_type", "demonym", "ethnic_groups", "ethnic_groups_year", "religion", "religion_year", "coordinates")),
    ("Government", ("government_type", "legislature", "upper_house", "lower_house")),
    ("Area", ("area_km2", "area_rank", "area_sq_mi", "percent_water")),
    ("Population", ("population_estimate", "population_estimate_year", "population_estimate_rank", "population_census", "population_census_year", "population_density_km2", "population_density_sq_mi")),
    ("GDP (PPP)", ("GDP_PPP", "GDP_PPP_year", "GDP_PPP_rank", "GDP_PPP_per_capita", "GDP_PPP_per_capita_rank")),
    ("GDP (nominal)", ("GDP_nominal", "GDP_nominal_year", "GDP_nominal_rank", "GDP_nominal_per_capita", "GDP_nominal_per_capita_rank")),
    ("Development", ("Gini", "Gini_year", "Gini_change", "HDI", "HDI_year", "HDI_change", "HDI_rank")),
    ("Miscellaneous", ("currency", "currency_code", "time_zone", "utc_offset", "time_zone_DST", "utc_offset_DST", "drives_on", "calling_code", "cctld", "iso3166code")),
]
LABELS = {
    "conventional_long_name": "Official name", "common_name": "Common name", "native_name": "Native name", "national_motto": "Motto", "national_anthem": "Anthem", "capital": "Capital", "largest_city": "Largest city",
    "official_languages": "Official languages", "languages": "Languages", "languages_type": "Languages type", "languages2": "Recognised languages", "languages2_type": "Languages (other) type", "demonym": "Demonym",
    "ethnic_groups": "Ethnic groups", "ethnic_groups_year": "Ethnic groups (year)", "religion": "Religion", "religion_year": "Religion (year)", "government_type": "Government", "legislature": "Legislature",
    "upper_house": "Upper house", "lower_house": "Lower house", "area_km2": "Area (km²)", "area_rank": "Area rank", "area_sq_mi": "Area (sq mi)", "percent_water": "Water (%)", "population_estimate": "Population estimate",
    "population_estimate_year": "Population est. year", "population_estimate_rank": "Population rank", "population_census": "Population census", "population_census_year": "Census year",
    "population_density_km2": "Density (/km²)", "population_density_sq_mi": "Density (/sq mi)", "GDP_PPP": "GDP (PPP)", "GDP_PPP_year": "GDP (PPP) year", "GDP_PPP_rank": "GDP (PPP) rank",
    "GDP_PPP_per_capita": "GDP (PPP) per capita", "GDP_PPP_per_capita_rank": "Per capita rank", "GDP_nominal": "GDP (nominal)", "GDP_nominal_year": "GDP (nominal) year", "GDP_nominal_rank": "GDP (nominal) rank",
    "GDP_nominal_per_capita": "GDP (nominal) per capita", "GDP_nominal_per_capita_rank": "Per capita rank", "Gini": "Gini coefficient", "Gini_year": "Gini year", "Gini_change": "Gini change", "HDI": "HDI", "HDI_year": "HDI year",
    "HDI_change": "HDI change", "HDI_rank": "HDI rank", "currency": "Currency", "currency_code": "Currency code", "time_zone": "Time zone", "utc_offset": "UTC offset", "utc_offset_DST": "UTC offset (DST)",
    "time_zone_DST": "Time zone (DST)", "drives_on": "Driving side", "calling_code": "Calling code", "cctld": "Internet TLD", "iso3166code": "ISO 3166 code", "coordinates": "Coordinates", "map_caption": "Map caption",
}
LISTED = frozenset(x for _, fields in SECTIONS for x in fields) | {"established", "leaders"}


def infobox_page(nodes: list[dict], name: str, subtitle: str = "") -> str:
    """The record as an HTML page: its sections, leaders, events, and then other fields."""
    record = _Record(nodes)
    by_label = {x["label"]: x for x in record.fields}
    rows: list[str] = []

    def section(title: str, lines: list[str], always: bool = False) -> None:
        if title and (lines or always):
            rows.append(f'<tr><td colspan="2" class="section">{escape(title)}</td></tr>')
        rows.extend(lines)

    def field(x: dict) -> list[str]:
        items = record.items(x)
        value = f"<ul>{''.join(f'<li>{escape(i)}</li>' for i in items)}</ul>" if items else escape(record.text(x))
        label = LABELS.get(x["label"], x["label"].replace("_", " ").title())
        return [f"<tr><th>{escape(label)}</th><td>{value}</td></tr>"] if value else []

    for title, fields in SECTIONS:
        section(title, [line for f in fields if f in by_label for line in field(by_label[f])])
    for label, title, first, second in (("leaders", "Leadership", "title", "name"), ("established", "Established", "label", "date")):
        if label in by_label:
            section(title, [f"<tr><th>{escape(a or '')}</th><td>{escape(b or '')}</td></tr>" for a, b in record.pairs(by_label[label], first, second) if a or b], always=True)
    section("Other", [line for x in record.fields if x["label"] not in LISTED for line in field(x)])
    under = f'<tr><td colspan="2" class="sub">{escape(subtitle)}</td></tr>' if subtitle else ""
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>{escape(name)}</title></head><body><table class="infobox"><tr><td colspan="2" class="name">{escape(name)}</td></tr>{under}{"".join(rows)}<tr><td colspan="2" class="foot">{len(nodes)} nodes</td></tr></table></body></html>\n'


def rendered(trees: DataFrame, how: Callable[[list[dict]], str], doc_id: str = "doc_id", name: str = "text") -> DataFrame:
    """The id and the text that ``how`` makes of each tree; null trees have none."""
    rows = trees.select(F.col(doc_id).cast("string").alias("doc_id"), "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([how(x) if x else None for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", name])

    return rows.mapInArrow(run, f"doc_id string, {name} string")


def infobox_pages(trees: DataFrame, subtitle: str = "") -> DataFrame:
    """``doc_id`` and ``html`` of each record."""
    rows = trees.select("doc_id", "nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [infobox_page(x, i.replace("_", " "), subtitle) if x else None for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])

    return rows.mapInArrow(run, "doc_id string, html string")


def _whole(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _rounded(x: str, places: int) -> Column:
    """A number to some places. Ties go to the even digit, as in SQL; format_string takes
    them up."""
    return F.expr(f"format_number({x}, '0.{'0' * places}')")


def _attr(**values: Column) -> Column:
    return F.concat(*(p for k, v in values.items() for p in (F.lit(f' {k}="'), xml_escaped(v.cast("string")), F.lit('"'))))


def diff_documents(scripts: DataFrame) -> DataFrame:
    """``src``, ``dst`` and the script as an XML document in the diff namespace."""
    node = lambda x, **more: F.concat(F.lit("      <idf:node"), _attr(label=x["label"], node_type=x["node_type"], **more), F.lit("/>\n"))

    def op(x: Column, k: Column) -> Column:
        ident = F.concat(F.lit("op"), (k + 1).cast("string"))
        insert = F.concat(F.lit("    <idf:insert"), _attr(id=ident, parent_path=x["parent_path"], position=x["position"]), F.lit(">\n"), node(x), F.lit("    </idf:insert>\n"))
        delete = F.concat(F.lit("    <idf:delete"), _attr(id=ident), F.lit(">\n"), node(x, path=x["path"]), F.lit("    </idf:delete>\n"))
        relabel = F.concat(F.lit("    <idf:relabel"), _attr(id=ident, path=x["path"]), F.lit(">\n      <idf:from>"), xml_escaped(x["label"], quotes=False), F.lit("</idf:from>\n      <idf:to>"), xml_escaped(x["new_label"], quotes=False), F.lit("</idf:to>\n    </idf:relabel>\n"))
        return F.when(x["op_type"] == "insert", insert).when(x["op_type"] == "delete", delete).otherwise(relabel)

    measured = similarity(scripts)
    head = F.concat(
        F.lit(f'<?xml version="1.0" ?>\n<idf:diff xmlns:idf="{DIFF_NAMESPACE}"'),
        _attr(source=F.col("src"), target=F.col("dst"), algorithm=F.col("algorithm"), ted_raw=_whole(F.col("raw_ted")), sim_inverse=_rounded("sim_inverse", 6), sim_ratio=_rounded("sim_ratio", 6)),
        F.lit(">\n  <idf:operations"), _attr(count=F.size("ops")), F.lit(">\n"),
    )
    return measured.select("src", "dst", F.concat(head, F.array_join(F.transform("ops", op), ""), F.lit("  </idf:operations>\n</idf:diff>\n")).alias("idf"))


def diff_page(forward: DataFrame, backward: DataFrame, costs: dict | None = None, on: list[str] | None = None) -> DataFrame:
    """``src``, ``dst`` and an HTML page with both directions' counts and operations.

    Directions of a pair meet by ids and algorithm, or by the columns ``on``, which tell
    repeated pairs apart.
    """
    on = on or ["src", "dst", "algorithm"]

    def cell(x: Column, k: Column) -> Column:
        short = lambda c: xml_escaped(F.substring(c, 1, 60))
        # Each label of a path is cut to 30 characters.
        path = lambda c: xml_escaped(F.array_join(F.transform(F.split(c, "/"), lambda p: F.substring(p, 1, 30)), "/"))
        detail = F.when(x["op_type"] == "relabel", F.concat(F.lit("<b>"), short(x["label"]), F.lit("</b> &rarr; <b>"), short(x["new_label"]), F.lit("</b>"))).when(
            x["op_type"] == "insert", F.concat(F.lit("<b>"), short(x["label"]), F.lit("</b> parent=<i>"), xml_escaped(F.coalesce(x["parent_label"], F.lit("ROOT"))), F.lit("</i> pos="), x["position"].cast("string"))
        ).otherwise(F.concat(F.lit("<b>"), short(x["label"]), F.lit("</b>")))
        where = F.when(x["op_type"] == "insert", F.when(x["parent_path"] == "", "/").otherwise(x["parent_path"])).otherwise(x["path"])
        return F.concat(F.lit('<tr class="'), x["op_type"], F.lit('"><td>'), (k + 1).cast("string"), F.lit("</td><td>"), x["op_type"], F.lit("</td><td>"), detail, F.lit("</td><td>"), path(where), F.lit("</td><td>"), _whole(x["cost"]), F.lit("</td></tr>"))

    def section(scripts: DataFrame, s: str) -> DataFrame:
        number = lambda kind: F.size(F.filter("ops", lambda x: x["op_type"] == kind)).cast("string")
        cost = F.aggregate("ops", F.lit(0.0), lambda acc, x: acc + x["cost"])
        stats = F.concat(F.lit("<p>ops "), F.size("ops").cast("string"), F.lit(", inserts "), number("insert"), F.lit(", deletes "), number("delete"), F.lit(", relabels "), number("relabel"), F.lit(", cost "), _whole(cost), F.lit("</p>"))
        body = F.concat(F.lit("<h2>"), xml_escaped("src"), F.lit(" → "), xml_escaped("dst"), F.lit("</h2>"), stats, F.lit("<table><tr><th>#</th><th>Op</th><th>Detail</th><th>Path</th><th>Cost</th></tr>"), F.array_join(F.transform("ops", cell), "\n"), F.lit("</table>"))
        a, b = ("src", "dst") if s == "fwd" else ("dst", "src")
        named = scripts.withColumns({s: body, f"{s}_n": F.size("src_nodes"), "src": F.col(a), "dst": F.col(b)})
        return named.select(*(["src", "dst", "algorithm"] if s == "fwd" else []), *(c for c in on if s != "fwd" or c not in ("src", "dst", "algorithm")), f"{s}_n", s)

    shown = escape(str({k: v for k, v in (costs or {}).items() if not k.startswith("_")}))
    both = section(forward, "fwd").join(section(backward, "rv"), on)
    title = F.concat(xml_escaped("src"), F.lit(" vs "), xml_escaped("dst"))
    meta = F.concat(F.lit("<p>Source "), xml_escaped("src"), F.lit(" ("), F.col("fwd_n").cast("string"), F.lit(" nodes), target "), xml_escaped("dst"), F.lit(" ("), F.col("rv_n").cast("string"), F.lit(" nodes), algorithm "), "algorithm", F.lit(f", costs <code>{shown}</code></p>"))
    return both.select("src", "dst", F.concat(F.lit('<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>Diff: '), title, F.lit("</title></head><body><h1>Diff: "), title, F.lit("</h1>"), meta, "fwd", "rv", F.lit("</body></html>\n")).alias("html"))


def report(scripts: DataFrame, at: datetime | None = None) -> DataFrame:
    """``src``, ``dst`` and a comparison in Markdown: metrics, counts, and the first five
    changes of each category, the largest category first. All of it comes from the pair's
    own row; ``at`` is the time that it states, by default now."""
    change = lambda x: F.when(x["op_type"] == "relabel", F.concat(F.lit("- **relabel** `"), x["field"], F.lit("`: `"), x["label"], F.lit("` → `"), x["new_label"], F.lit("`"))).otherwise(F.concat(F.lit("- **"), x["op_type"], F.lit("** `"), x["field"], F.lit("` (`"), x["label"], F.lit("`)")))
    rows = similarity(scripts).withColumn("cats", F.transform("ops", lambda x: category(x["field"])))
    of = lambda c: F.filter("ops", lambda x, i: F.get(F.col("cats"), i) == c)
    # Of categories with as many changes, the one that comes first in the script.
    rows = rows.withColumn("groups", F.transform(F.array_distinct("cats"), lambda c, k: F.struct((-F.size(of(c))).alias("k"), k.alias("first"), c.alias("category"), of(c).alias("ops"))))
    number = lambda ops, kind: F.size(F.filter(ops, lambda x: x["op_type"] == kind)).cast("string")

    def section(g: Column) -> Column:
        n = F.size(g["ops"])
        more = F.when(n > 5, F.concat(F.lit("\n- *... and "), (n - 5).cast("string"), F.lit(" more*"))).otherwise("")
        counts = [F.lit(" changes: "), number(g["ops"], "insert"), F.lit("ins, "), number(g["ops"], "delete"), F.lit("del, "), number(g["ops"], "relabel"), F.lit("rel)\n")]
        return F.concat(F.lit("\n### "), F.initcap(g["category"]), F.lit(" ("), n.cast("string"), *counts, F.array_join(F.transform(F.slice(g["ops"], 1, 5), change), "\n"), more)

    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("string")
    kind = lambda k: number(F.col("ops"), k)
    text = F.concat(
        F.lit("# Country Comparison: "), "src", F.lit(" vs "), "dst", F.lit(f"\n*Generated: {at or datetime.now():%Y-%m-%d %H:%M}*\n\n## Structural Similarity (TED)\n- **Tree Edit Distance**: "), F.col("raw_ted").cast("string"),
        F.lit("\n- **"), "src", F.lit(" nodes**: "), size("src_nodes"), F.lit(", **"), "dst", F.lit(" nodes**: "), size("dst_nodes"),
        F.lit("\n- **Similarity (inverse)**: "), _rounded("sim_inverse", 4), F.lit("\n- **Similarity (ratio)**: "), _rounded("sim_ratio", 4), F.lit("\n\n## Edit Operations ("), size("ops"),
        F.lit(" total)\n- Inserts: "), kind("insert"), F.lit("\n- Deletes: "), kind("delete"), F.lit("\n- Relabels: "), kind("relabel"), F.lit("\n\n## Changes by Category\n"), F.array_join(F.transform(F.sort_array(F.transform("groups", lambda g: F.struct(g["k"], g["first"], section(g).alias("text")))), lambda g: g["text"]), "\n"),
    )
    return rows.select("src", "dst", text.alias("report"))
