"""Distances, mappings, scripts and patches against brute force and stated expectations."""

import functools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.model import LEAF
from treeloom.operators import nodes as N
from treeloom.operators.distance import Distance, both_ways, distances, shape, similarity, with_trees
from treeloom.operators.patch import apply, refined, residual
from treeloom.operators.script import counted, edit_ops, inverted, preview, script_text, with_ops
from treeloom.operators.similarity_join import within
from treeloom.plans.run import summary_rows
from treeloom.sources.config import CostModel
from treeloom.sources.xml import numbered, parse, parse_trees, read_trees

FIELDS = ["node_id", "pre", "parent_id", "child_pos", "depth", "label", "node_type", "subtree_size", "lml", "path", "field", "attribute"]


def shaped(rows):
    return shape([r[5] for r in rows], [r[6] for r in rows], [r[8] for r in rows])


def ted(a, b, costs=None, algorithm="chawathe"):
    return Distance(shaped(parse(a)), shaped(parse(b)), CostModel.of(costs), algorithm).total


def plain(a, b, costs, algorithm):
    """Forest distance by its definition, on nested trees."""
    text, structure = costs.relabel_prices(algorithm)

    @functools.cache
    def go(f, g):
        if not f and not g:
            return 0
        best = []
        if f:
            best.append(go(f[:-1] + f[-1][2], g) + costs.delete)
        if g:
            best.append(go(f, g[:-1] + g[-1][2]) + costs.insert)
        if f and g:
            x, y = f[-1], g[-1]
            price = 0 if x[0] == y[0] else text if x[1] == y[1] == LEAF else structure
            best.append(go(f[:-1], g[:-1]) + go(x[2], y[2]) + price)
        return min(best)

    return go((a,), (b,))


def trees(most=6):
    leaf = st.tuples(st.sampled_from("abc"), st.sampled_from(["leaf", "element"]), st.just(()))
    return st.recursive(leaf, lambda kids: st.tuples(st.sampled_from("abc"), st.just("element"), st.lists(kids, max_size=3).map(tuple)), max_leaves=most)


def rows_of(t):
    nested = lambda t: (t[0], t[1], [nested(x) for x in t[2]], False)
    return numbered(nested(t))


MODELS = [CostModel(), CostModel(1, 2, 1), CostModel(10, 10, 5, 3, 1), CostModel(1, 1, 1, 0, 2)]


@given(trees(), trees(), st.sampled_from(MODELS), st.sampled_from(["chawathe", "nierman_jagadish"]))
@settings(max_examples=400, deadline=None)
def test_distance_and_mapping(a, b, costs, algorithm):
    ra, rb = rows_of(a), rows_of(b)
    found = Distance(shaped(ra), shaped(rb), costs, algorithm)
    assert found.total == plain(a, b, costs, algorithm)
    pairs = found.mapping()
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    text, structure = costs.relabel_prices(algorithm)
    price = sum(0 if ra[i - 1][5] == rb[j - 1][5] else text if ra[i - 1][6] == rb[j - 1][6] == LEAF else structure for i, j in pairs)
    assert price + (len(ra) - len(pairs)) * costs.delete + (len(rb) - len(pairs)) * costs.insert == found.total
    for i, j in pairs:
        for k, m in pairs:
            assert (i < k) == (j < m) and (ra[i - 1][1] < ra[k - 1][1]) == (rb[j - 1][1] < rb[m - 1][1])


def test_stated_distances():
    assert ted("<a><b>x</b></a>", "<a><b>x</b></a>") == 0
    assert ted("<a/>", "<a><b>x</b></a>") == 2
    assert ted("<a><b>hello</b></a>", "<a><b>world</b></a>") == 1
    assert ted("<a><b>x</b><c>y</c></a>", "<a><b>x</b></a>") == 2
    assert ted("<a><b>x</b></a>", "<a><b>y</b></a>", {"insert": 2, "delete": 3, "relabel": 5}) == 5
    one, two = "<a><b>x</b><c>y</c></a>", "<a><b>x</b></a>"
    assert (ted(one, two, {"delete": 2}), ted(two, one, {"delete": 2})) == (4, 2)
    split = {"insert": 10, "delete": 10, "relabel_structure": 3, "relabel_content": 1}
    assert ted("<a><b>x</b></a>", "<a><c>x</c></a>", split, "nierman_jagadish") == 3
    assert ted("<a><b>hello</b></a>", "<a><b>world</b></a>", {**split, "insert": 1, "delete": 1}, "nierman_jagadish") == 1


def test_parsing():
    rows = parse('<country name="T" a="1"><capital>Tv</capital><e><event><label>x</label></event></e><z/>tail</country>')
    assert [(r[1], r[5], r[6]) for r in sorted(rows, key=lambda r: r[1])][:5] == [(1, "country", "element"), (2, "a=1", "leaf"), (3, "name=T", "leaf"), (4, "capital", "element"), (5, "Tv", "leaf")]
    assert rows[-1][7] == len(rows) == 10 and rows[-1][2] is None
    assert [r[9] for r in rows if r[5] == "x"] == ["country/e/event/label/x"] and [r[10] for r in rows if r[5] == "x"] == ["e"]
    assert [r[5] for r in parse("<g>95% Arab, 4% other</g>", "token_nodes")] == ["95", "Arab", "4", "other", "g"]
    assert len(parse("<g>95% Arab, 4% other</g>")) == 2
    assert len(parse("<a>" * 3000 + "</a>" * 3000)) == 3000


DOCS = [
    ("A", '<country name="A"><capital>X</capital><area_km2>100</area_km2><established><event><label>l</label><date>1</date></event></established></country>'),
    ("B", '<country name="B"><capital>Y</capital><population>500</population><leaders><leader><title>P</title><name>N</name></leader></leaders></country>'),
    ("C", "<root><a><b><c>val</c></b></a></root>"),
    ("D", "<root><a><c>val</c></a></root>"),
    ("E", "<broken>"),
    ("F", None),
]


@pytest.fixture(scope="module")
def table(spark):
    return parse_trees(spark.createDataFrame(DOCS, "doc_id string, xml string"))


def pairs(spark, table, *names):
    return with_trees(spark.createDataFrame(list(names), "src string, dst string"), table)


def test_tables(spark, table):
    assert table.count() == 6 and table.where("n IS NULL").count() == 2
    nodes = N.to_nodes(table)
    assert N.to_trees(nodes).orderBy("doc_id").collect() == table.where("n IS NOT NULL").orderBy("doc_id").collect()
    roots = {(r["doc_id"], r["lml"]): r["keyroot"] for r in N.keyroots(nodes).collect()}
    for d in ("A", "B", "C", "D"):
        mine = parse(dict(DOCS)[d])
        assert shaped(mine).keyroots() == sorted(k for (doc, _), k in roots.items() if doc == d)
    texts = {(r["doc_id"], r["label"]): r["text"] for r in N.fields(table).collect()}
    assert texts[("A", "capital")] == "X" and texts[("A", "established")] == "[event]" and texts[("B", "leaders")] == "[leader]"
    all_text = {(r["doc_id"], r["node_id"]): r["leaf_text"] for r in N.leaf_texts(table).collect()}
    assert all_text[("A", len(parse(DOCS[0][1])))] == "name=A X 100 l 1"
    assert {r["doc_id"]: (r["n_nodes"], r["top_labels"]) for r in N.summary(table).collect()}["A"] == (12, "name=A,capital,area_km2,established")
    renamed = N.normalise(table, {"capital": "city", "event": "happening"})
    assert [r["path"] for r in N.to_nodes(renamed).where("label IN ('X', 'l')").orderBy("pre").collect()] == ["country/city/X", "country/established/happening/label/l"]
    assert N.to_nodes(renamed).where("field = 'city' AND doc_id = 'A'").count() == 2


def test_scripts_and_patches(spark, table):
    asked = pairs(spark, table, ("A", "B"), ("C", "D"), ("A", "A"), ("B", "C"), ("A", "E"), ("F", "B"))
    for costs in MODELS:
        for algorithm in ("chawathe", "nierman_jagadish"):
            scripts = with_ops(distances(asked, costs, algorithm), costs)
            for r in counted(scripts).collect():
                assert r["total_cost"] == r["ted"] and r["total_ops"] == r["inserts"] + r["deletes"] + r["relabels"]
    scripts = with_ops(distances(asked))
    whole = scripts.where("src_nodes IS NOT NULL AND dst_nodes IS NOT NULL")
    assert {(r["src"], r["dst"]): r["residual"] for r in residual(whole).collect()} == {("A", "B"): 0, ("C", "D"): 0, ("A", "A"): 0, ("B", "C"): 0}
    target = {d: [(x["label"], x["node_type"], x["pre"], x["parent_id"]) for x in r["nodes"]] for d, r in ((r["doc_id"], r) for r in table.collect()) if r["nodes"]}
    for r in apply(whole).collect():
        assert [(x["label"], x["node_type"], x["pre"], x["parent_id"]) for x in r["nodes"]] == target[r["dst"]]
    again = refined(whole.withColumn("ops", F.slice("ops", 2, 100))).collect()
    assert {(r["src"], r["dst"]): (r["residual"], r["rounds"]) for r in again} == {("A", "B"): (0, 2), ("C", "D"): (0, 2), ("A", "A"): (0, 1), ("B", "C"): (0, 2)}
    assert {r["rounds"] for r in refined(whole, max_rounds=1).collect()} == {1}
    for r in apply(inverted(whole)).collect():
        assert [(x["label"], x["node_type"], x["pre"], x["parent_id"]) for x in r["nodes"]] == target[r["dst"]]
    kinds = [(r["op_type"], r["label"]) for r in edit_ops(scripts).where("src = 'C' AND dst = 'D'").orderBy("op_seq").collect()]
    assert kinds == [("delete", "b")]
    order = [r["op_type"] for r in edit_ops(scripts).where("src = 'A' AND dst = 'B'").orderBy("op_seq").collect()]
    assert order == sorted(order, key=["relabel", "delete", "insert"].index)
    assert {r["total_ops"] for r in counted(scripts).where("src = 'A' AND dst = 'E'").collect()} == {12}
    assert preview(scripts, 3).groupBy("src", "dst").count().agg({"count": "max"}).first()[0] == 3
    assert "EditScript — 1 ops, cost=1" in [r["script"].split("\n")[0] for r in script_text(scripts).collect()]


def test_metrics_and_directions(spark, table):
    rows = {(r["src"], r["dst"]): r for r in similarity(distances(pairs(spark, table, ("C", "D"), ("A", "A"), ("E", "F")))).collect()}
    assert rows["A", "A"]["sim_inverse"] == rows["A", "A"]["sim_ratio"] == 1.0
    assert rows["C", "D"]["sim_inverse"] == 0.5 and rows["C", "D"]["sim_ratio"] == 1 - 1 / 9
    assert rows["E", "F"]["sim_ratio"] == 1.0
    ways = both_ways(pairs(spark, table, ("A", "B")), {"delete": 2}).collect()
    assert len(ways) == 2 and all(r["asymmetric"] == (r["ted_fwd"] != r["ted_rv"]) for r in ways)
    with pytest.raises(ValueError):
        distances(pairs(spark, table, ("A", "B")), algorithm="unknown")
    with pytest.raises(ValueError):
        distances(pairs(spark, table, ("A", "B")).withColumn("Ted", F.lit(1)))


def test_repeated_and_null_pairs(spark, table):
    asked = pairs(spark, table, ("A", "B"), ("A", "B"), (None, "B"), ("A", None), (None, None)).withColumn("own", F.lit("x"))
    scripts = with_ops(distances(asked))
    assert scripts.count() == 5 and scripts.columns[:5] == asked.columns
    assert both_ways(asked).count() == 10 and residual(scripts).count() == 5 and summary_rows(asked).count() == 5
    assert sorted(r["ted"] for r in scripts.collect())[0] == 0 and sorted(r["total_ops"] for r in counted(scripts).where("src IS NULL").collect()) == [0, 12]


def test_plans(spark, table):
    """Trees are not broadcast, and a pair's row is shuffled for its trees alone."""
    plan = with_ops(distances(pairs(spark, table, ("A", "B"))))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("ArrowEvalPython") == 1
    assert plan.count("Exchange hashpartitioning") == 4


@pytest.mark.skipif("RECORDS_DIR" not in os.environ, reason="RECORDS_DIR names a folder of XML records")
def test_stated_figures_of_two_records(spark):
    docs = read_trees(spark, os.environ["RECORDS_DIR"]).where("doc_id IN ('Lebanon', 'Switzerland')")
    scripts = with_ops(distances(with_trees(spark.createDataFrame([("Lebanon", "Switzerland")], "src string, dst string"), docs)))
    r = counted(scripts).first()
    assert {x["doc_id"]: x["n"] for x in docs.collect()} == {"Lebanon": 173, "Switzerland": 145}
    assert (r["ted"], r["inserts"], r["deletes"], r["relabels"]) == (121, 12, 40, 69)


def test_similarity_join(spark):
    rng = random.Random(3)
    made = []
    for k in range(40):
        kids = [(rng.choice("abcd"), "leaf", (), ) for _ in range(rng.randint(0, 5))]
        made.append((f"t{k}", (rng.choice("xy"), "element", tuple(kids))))
    rows = [(d, [dict(zip(FIELDS, x)) for x in rows_of(t)]) for d, t in made]
    from treeloom.model import TREE

    df = spark.createDataFrame([(d, len(n), n) for d, n in rows], TREE)
    for limit in (0, 2):
        wanted = {}
        for k, (d, t) in enumerate(made):
            for e, u in made[:k]:
                x = plain(t, u, CostModel(), "chawathe")
                if x <= limit:
                    wanted[tuple(sorted((d, e)))] = float(x)
        assert {(r["src"], r["dst"]): r["ted"] for r in within(df, limit).collect()} == wanted
