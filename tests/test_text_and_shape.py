"""Cleaning, tokenising, numbers, shaping and the catalogue."""

import json
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.functions import text as X
from treeloom.functions.wikitext import clean, clean_value, extract_list_items, list_items
from treeloom.operators.shape import build_xml
from treeloom.sources.catalog import available, chosen_template, missing, resolve
from treeloom.sources.config import CostModel, load_aliases, load_costs, load_strategy
from treeloom.sources.xml import read_documents, read_trees

VALUES = {
    "plain  text here ": "plain text here",
    "a<!-- x\ny -->b<ref name=a/>c<ref>q</ref>d</ref>": "abcd",
    "[[Beirut|The city]] and [[Tyre]]": "The city and Tyre",
    "1{{efn|note {{nested|x}}}}2{{cite web|url=x}}3{{Cite_book|t}}4": "1234",
    "{{ubl|a|[[b|c]]|efn|name = z|{{small|d}}}}": "a, c",
    "{{unbulleted list|one|\n* two\n* three {{x}}\n}}": "one, two, three",
    "from|=|Q686}}": "from|=|Q686}}",
    "a }} b {{c}} d": "a c",
    "x {{unclosed|y": "x",
    "{{plainlist}} rest": "rest",
    "{{hlist|a|{{ubl|b|c}}}} tail": "a tail",
    "<br />line<span style='x'>s</span>": "lines",
    "{{Tree list}}\n* a\n{{Tree list/end}}b": "b",
    "": "",
}


def test_clean_values(spark):
    for raw, wanted in VALUES.items():
        assert clean(raw) == wanted, raw
    df = spark.createDataFrame([(k,) for k in VALUES] + [(None,)], "raw string")
    got = {r["raw"]: r["c"] for r in df.select("raw", clean_value("raw").alias("c")).collect()}
    assert got == VALUES | {None: None}
    many = "".join(f"a{k}{{{{efn|x}}}}{{{{small|y}}}}" for k in range(60))
    assert clean(many) == "".join(f"a{k}" for k in range(60))
    assert list_items("{{ubl|a|b}} trailing") == ["a", "b"] and list_items(" plain [[x|y]] ") == ["plain y"] and list_items("<!-- -->") == []
    assert [r["i"] for r in df.where("raw LIKE '{{unb%'").select(extract_list_items("raw").alias("i")).collect()] == [["one", "two", "three"]]


@given(st.text(st.sampled_from("{}[]|<>*/ab \n"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_clean_never_fails(raw):
    assert "{{" not in clean(raw)
    list_items(raw)


def test_native_stages_give_the_same(spark):
    rng = random.Random(1)
    parts = ["{", "}", "[[", "]]", "|", "<!--", "-->", "<ref x>", "</ref>", "<b>", "/>", "*", " ", "\n", "a", "\x1d", "\u00a0", "|efn|", "{{efn|", "}}"]
    values = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in values], "raw string").select("raw", clean_value("raw").alias("c"), extract_list_items("raw").alias("i")).collect()
    assert [(r["raw"], r["c"], r["i"]) for r in rows] == [(r["raw"], clean(r["raw"]), list_items(r["raw"])) for r in rows] and len(rows) == 3000


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_column_functions(spark):
    assert one(spark, X.tokenize("x"), "$11,793") == ["11", "793"] and one(spark, X.tokenize("x"), "") == [] and one(spark, X.tokenize("x"), "Éire 0.752") == ["ire", "0", "752"]
    assert one(spark, X.normalise_whitespace("x"), "  a \n b ") == "a b" and one(spark, X.strip("x"), " a b\t") == "a b"
    for column, raw, wanted in [
        (X.strip_comments("x"), "a<!-- \n -->b", "ab"), (X.strip_refs("x"), "a<ref x/>b<REF>c\n</ref>d</ref>", "abd"), (X.strip_tags("x"), "a<b>c</b><br/>", "ac"), (X.unwrap_links("x"), "[[a|b]] [[c]]", "b c"),
        (X.strip_inline_notes("x"), "a|efn|b\n |c", "a\n |c"), (X.strip_tree_lists("x"), "{{tree list}}x{{Tree list/end}}y", "y"), (X.safe_tag("x"), "9 a-b.c%", "_9_a-b.c_"), (X.safe_tag("x"), "", "_field"),
    ]:
        assert one(spark, column, raw) == wanted
    for raw, wanted in {"": True, " EFN ": True, "name = x": True, "</ref": True, "url-x": True, "Reference": False, "data": False}.items():
        assert one(spark, X.is_junk_item("x"), raw) is wanted
    for raw, wanted in {"label1": True, "Gini_ref": True, "image_coat": True, "titles": False, "capital": False, "area_label2": True}.items():
        assert one(spark, X.is_dropped_field("x"), raw) is wanted
    assert one(spark, X.is_dropped_field("x", reference_suffix=False), "Gini_ref") is False
    assert one(spark, X.is_bullet_block("x"), "a\n * b") is True


def test_numbers(spark):
    for raw, wanted in {"$11,793": 11793.0, "$78.233 billion": 78.233, "9 June 1861": 91861.0, "12-34": None, "": None, ".5": 0.5, "5.": 5.0, "-3": -3.0, "1.2.3": None, None: None}.items():
        assert one(spark, X.parse_number("x"), raw) == wanted, raw
    df = spark.createDataFrame([("11793", "97660"), ("0", "0"), ("0", "2"), ("3", "0"), ("2", "2"), ("-1", "-2"), ("a", "1")], "a string, b string")
    rows = [r["m"] for r in df.select(X.magnitude("a", "b").alias("m")).collect()]
    assert (rows[0]["ratio"], rows[0]["abs_diff"], rows[0]["direction"]) == (8.281, 85867.0, "increase")
    assert (rows[1]["ratio"], rows[1]["abs_diff"], rows[1]["direction"]) == (1.0, None, "same")
    assert math.isinf(rows[2]["ratio"]) and [r["direction"] for r in rows[2:6]] == ["increase", "decrease", "same", "increase"] and rows[6] is None


RECORD = [("conventional_long_name", "Test [[Land|land]]"), ("image_flag", "x.svg"), ("Gini_ref", "<ref>x</ref>"), ("established_event1", "Start"), ("established_date1", "{{x}}"), ("established_date3", "1900"), ("languages", "{{ubl|A|B & C}}"), ("leader_title2", "King"), ("englishmotto", "m"), ("national_motto", "n"), ("9x", "v"), ("blank", "  "), ("none", None)]


def test_build_xml(spark):
    df = spark.createDataFrame([("T", 'T "1"', RECORD), ("E", "E", [])], "doc_id string, name string, fields array<struct<key:string,value:string>>")
    out = {r["doc_id"]: r["xml"] for r in build_xml(df, aliases={"englishmotto": "national_motto"}).collect()}
    assert out["T"] == (
        '<country name="T &quot;1&quot;"><conventional_long_name>Test land</conventional_long_name><languages>A, B &amp; C</languages><national_motto>m</national_motto><_9x>v</_9x>'
        "<established><event><label>Start</label><date></date></event><event><date>1900</date></event></established><leaders><leader><title>King</title></leader></leaders></country>"
    )
    assert out["E"] == '<country name="E"></country>'
    plan = build_xml(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    odd = spark.createDataFrame([(None, "m", [("a", "1")]), ("R", "r1", [("a", "2"), ("leader_title30", "t")]), ("R", "r2", [("a", "3"), (None, "x")]), ("N", None, None)], df.schema)
    assert sorted(r["xml"] for r in build_xml(odd).collect()) == sorted(['<country name="m"><a>1</a></country>', '<country name="r1"><a>2</a><leaders><leader><title>t</title></leader></leaders></country>', '<country name="r2"><a>3</a></country>', '<country name=""></country>'])
    items = {r["doc_id"]: r["xml"] for r in build_xml(df, strategy="token_nodes").collect()}
    assert "<languages><item>A</item><item>B &amp; C</item></languages>" in items["T"]


def test_files_and_names(spark, tmp_path):
    for name in ("Sri_Lanka", "Togo"):
        (tmp_path / f"{name}.xml").write_text(f'<country name="{name}"><capital>x</capital></country>')
    docs = read_documents(spark, str(tmp_path / "*.xml"))
    assert [r["name"] for r in available(docs).collect()] == ["Sri Lanka", "Togo"]
    assert {r["doc_id"]: r["n"] for r in read_trees(spark, str(tmp_path)).collect()} == {"Sri_Lanka": 4, "Togo": 4}
    asked = spark.createDataFrame([(x,) for x in ("Togo", " sri lanka ", "SRI_LANKA", "Nowhere")], "name string")
    assert {r["name"]: r["doc_id"] for r in resolve(asked, docs).collect()} == {"Togo": "Togo", " sri lanka ": "Sri_Lanka", "SRI_LANKA": "Sri_Lanka", "Nowhere": None}
    assert [r["name"] for r in missing(asked.where("name IN ('Togo', 'Nowhere')"), docs).collect()] == ["Nowhere"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "costs.json").write_text(json.dumps({"insert": 1, "delete": 2, "_comment": "x"}))
    assert load_costs(spark, str(tmp_path / "c" / "costs.json")) == CostModel(1, 2, 1) and load_costs(spark, str(tmp_path / "c" / "no.json")) == CostModel()
    assert load_aliases(spark, str(tmp_path / "none.json")) == {} and load_strategy(spark, str(tmp_path / "none.json")) == "single_node"


def test_templates(spark):
    kind = "t array<struct<template:string,fields:array<struct<key:string,value:string>>>>"
    df = spark.createDataFrame([([("Other", [("a", "1")]), ("Infobox Country x", [("template", "q"), ("capital", "C")])],), ([("Other", [])],)], kind)
    assert [r["f"] and [tuple(x) for x in r["f"]] for r in df.select(chosen_template(df["t"]).alias("f")).collect()] == [[("capital", "C")], None]
