"""The query API and the renderers."""

import json
import xml.etree.ElementTree as ET

import pytest

from treeloom.operators.distance import distances, with_trees
from treeloom.operators.patch import apply
from treeloom.operators.script import with_ops
from treeloom.operators.semantic import categorised, category, change_summary
from treeloom.plans import render
from treeloom.plans.query_api import Library, dispatch, schemas
from treeloom.plans.run import main, run
from treeloom.sources.catalog import collected
from treeloom.sources.xml import parse_trees

DOCS = [
    ("Old_Land", '<country name="Old_Land"><capital>X</capital><area_km2>100</area_km2><HDI>0.5</HDI><languages><item>A</item><item>B</item></languages><established><event><label>l &amp; m</label><date>1</date></event></established></country>'),
    ("New_Land", '<country name="New_Land"><capital>Y=z</capital><area_km2>250</area_km2><population_estimate>500</population_estimate><odd_field>q</odd_field><leaders><leader><title>P</title><name>N</name></leader></leaders></country>'),
]


@pytest.fixture(scope="module")
def trees(spark):
    return parse_trees(spark.createDataFrame(DOCS, "doc_id string, xml string")).persist()


@pytest.fixture(scope="module")
def scripts(spark, trees):
    return with_ops(distances(with_trees(spark.createDataFrame([("Old_Land", "New_Land"), ("New_Land", "Old_Land")], "src string, dst string"), trees))).persist()


def test_library(trees):
    library = Library(trees)
    assert [r["name"] for r in library.list_documents().collect()] == ["New Land", "Old Land"]
    info = library.document_info("old land").orderBy("pos").collect()
    assert (info[0]["node_count"], info[0]["field_count"]) == (19, 5)
    assert {r["field"]: r["text"] for r in info}["languages"] == "item: A; item: B" or {r["field"]: r["text"] for r in info}["languages"].startswith("item")
    assert library.document_info("nowhere").first()["error"] == "no data for nowhere"
    row = library.compare("Old Land", "New_Land").first()
    assert row["total_ops"] == row["inserts"] + row["deletes"] + row["relabels"] == row["ted"] and row["t1_nodes"] == 19
    assert library.compare("Old Land", "None").first()["error"] == "no data for None"
    details = library.script_details("Old Land", "New Land", shown=4).orderBy("index").collect()
    assert [r["index"] for r in details] == [0, 1, 2, 3] and all(r["truncated"] for r in details)
    found = lambda f: library.field_value("Old Land", f).first()
    assert (found("CAPITAL")["field"], found("CAPITAL")["value"]) == ("capital", "X")
    assert found("lang")["similar_fields"] == ["languages"] and found("lang")["error"] == "field not found"
    assert found("zzz")["available_fields"] == ["capital", "area_km2", "HDI", "languages", "established"]
    fields = {r["field"]: (r["value1"], r["value2"], r["same"]) for r in library.compare_fields("Old Land", "New Land", ["Capital", "HDI", "none"]).collect()}
    assert fields == {"Capital": ("X", "Y=z", False), "HDI": ("0.5", "(not present)", None), "none": ("(not present)", "(not present)", None)}
    assert sum(r["count"] for r in library.semantic_similarity("Old Land", "New Land").collect()) == row["total_ops"]
    assert "## Changes by Category" in library.report("Old Land", "New Land").first()["report"]
    answer = json.loads(dispatch(library, "compare_countries", {"country1": "Old Land", "country2": "New Land"}))
    assert answer["rows"][0]["ted"] == row["ted"]
    assert "error" in json.loads(dispatch(library, "no_tool", {})) and "error" in json.loads(dispatch(library, "get_field_value", {"bad": 1}))


def test_semantics(spark, scripts):
    rows = spark.createDataFrame([("capital",), ("HDI",), ("zzz",), ("leaders",), ("established",)], "f string").select(category("f").alias("c")).collect()
    assert [r["c"] for r in rows] == ["geographic", "development", "other", "political", "historical"]
    assert spark.createDataFrame([("abc",)], "f string").select(category("f", {"x": ["b"], "y": ["ab*"]}).alias("c")).first()["c"] == "y"
    ops = categorised(scripts).where("src = 'Old_Land' AND label = '100'").first()
    assert ops["magnitude"]["ratio"] == 2.5 and ops["category"] == "geographic"
    for r in change_summary(scripts, shown=1).collect():
        assert len(r["changes"]) == 1 and r["truncated"] == (r["count"] > 1) and r["count"] == r["inserts"] + r["deletes"] + r["relabels"]


def test_trees_as_text(trees):
    text = {r["doc_id"]: r["text"] for r in render.rendered(trees, render.ascii_tree).collect()}["Old_Land"].split("\n")
    assert text[:3] == ["country  (19 nodes)", "├── name=Old_Land  [leaf]", "├── capital"] and text[3] == "│   └── X  [leaf]" and text[-1] == "            └── 1  [leaf]"
    for r in render.rendered(trees, render.xml_tree, name="xml").collect():
        assert ET.canonicalize(r["xml"], strip_text=True) == ET.canonicalize(dict(DOCS)[r["doc_id"]], strip_text=True)
    wiki = {r["doc_id"]: r["text"] for r in render.rendered(trees, render.wikitext).collect()}
    assert "| languages = {{unbulleted list|A|B}}" in wiki["Old_Land"] and "| established_date1 = 1" in wiki["Old_Land"]
    assert wiki["New_Land"].endswith("| leader_title1 = P\n| leader_name1 = N\n}}")
    page = {r["doc_id"]: r["html"] for r in render.infobox_pages(trees, "sub").collect()}
    assert "<th>Area (km²)</th><td>100</td>" in page["Old_Land"] and "<ul><li>A</li><li>B</li></ul>" in page["Old_Land"] and "l &amp; m" in page["Old_Land"]
    assert ">Other<" in page["New_Land"] and "<th>Odd Field</th>" in page["New_Land"] and "<th>P</th><td>N</td>" in page["New_Land"]


def test_diffs(scripts):
    for r in render.diff_documents(scripts).collect():
        root = ET.fromstring(r["idf"])
        assert root.tag == "{urn:idpa:diff:1.0}diff" and (root.get("source"), root.get("target"), root.get("algorithm")) == (r["src"], r["dst"], "chawathe")
        ops = root[0]
        assert len(ops) == int(ops.get("count")) == int(root.get("ted_raw"))
        assert {x.tag.split("}")[1] for x in ops} <= {"insert", "delete", "relabel"} and [x.get("id") for x in ops] == [f"op{k + 1}" for k in range(len(ops))]
    fwd, rv = scripts.where("src = 'Old_Land'"), scripts.where("src = 'New_Land'")
    page = render.diff_page(fwd, rv, {"insert": 1, "_comment": "x"}).first()["html"]
    assert page.count("<h2>") == 2 and "_comment" not in page and 'class="relabel"' in page


def test_run(spark, trees, tmp_path):
    pairs = spark.createDataFrame([("Old_Land", "New_Land")], "src string, dst string")
    row = run(trees, pairs, str(tmp_path / "out")).first()
    assert row["fwd_perfect"] and row["rv_perfect"] and row["ted_fwd"] == row["ted_rv"] == row["ops_fwd"]
    assert spark.read.csv(str(tmp_path / "out" / "summary"), header=True).count() == 1
    xml = spark.read.parquet(str(tmp_path / "out" / "patched_xml")).where("doc_id = 'Old_Land->New_Land'").first()["xml"]
    assert "Y=z" in xml and "population_estimate" in xml
    assert [p.name for p in (tmp_path / "out" / "idf_files").glob("doc_id=*")] and "{{Infobox" in spark.read.text(str(tmp_path / "out" / "patched_wikitext_files"), wholetext=True).first()["value"]
    assert apply(with_ops(distances(with_trees(pairs.where("false"), trees)))).count() == 0
    library = Library(trees, output=str(tmp_path / "again"))
    answer = json.loads(dispatch(library, "run_full_pipeline", {"country1": "Old Land", "country2": "New Land"}))
    assert answer["rows"][0]["fwd_perfect"] and answer["rows"][0]["source"] == "Old_Land"


def test_command_line(spark, tmp_path):
    for name, xml in DOCS:
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / f"{name}.xml").write_text(xml)
    docs, out = str(tmp_path / "docs"), lambda x: str(tmp_path / x)
    read = lambda x: spark.read.text(out(x), wholetext=True).first()["value"]
    main(["diff", docs, "Old Land", "New Land", out("diff")])
    assert ET.fromstring(read("diff")).get("target") == "New_Land"
    main(["patch", docs, "Old Land", "New Land", out("patched"), "--direction", "reverse"])
    assert ET.canonicalize(read("patched"), strip_text=True) == ET.canonicalize(dict(DOCS)["Old_Land"], strip_text=True)
    main(["postprocess", docs, "Old Land", out("page")])
    assert "<th>Area (km²)</th>" in read("page")
    main(["run", docs, "Old Land", "New Land", out("run")])
    assert spark.read.parquet(out("run/summary_rows")).first()["rv_perfect"]
    with pytest.raises(SystemExit):
        main(["diff", docs, "Old Land", "No Land", out("none")])


def test_collecting(spark, trees):
    kind = "name string, templates array<struct<template:string,fields:array<struct<key:string,value:string>>>>"
    fetched = spark.createDataFrame([("Third Land", [("Infobox country", [("capital", "[[C]]"), ("template", "x")])]), ("Old Land", [("Infobox country", [])]), ("Bare", [("Other", [])])], kind)
    names = spark.createDataFrame([("Third Land",), ("Old Land",), ("Bare",), ("Nowhere",), ("Bare",)], "name string")
    made = {r["name"]: (r["doc_id"], r["xml"], r["error"]) for r in collected(names, fetched, trees).collect()}
    assert made == {"Third Land": ("Third_Land", '<country name="Third Land"><capital>C</capital></country>', None), "Bare": ("Bare", None, "no infobox for Bare"), "Nowhere": ("Nowhere", None, "no infobox for Nowhere")}
    answer = json.loads(dispatch(Library(trees, fetched=fetched), "collect_country", {"country": "Third Land"}))
    assert answer["rows"][0]["success"] and "error" in json.loads(dispatch(Library(trees), "collect_country", {"country": "x"}))
    shown = {x["function"]["name"]: x["function"]["parameters"] for x in schemas()}
    assert len(shown) == 10 and shown["compare_countries"]["properties"]["algorithm"]["enum"] == ["chawathe", "nierman_jagadish"] and shown["compare_specific_fields"]["required"] == ["country1", "country2", "fields"]
