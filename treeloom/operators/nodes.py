"""Node tables and tree tables: conversions, traversals, renaming, texts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.model import ELEMENT, LEAF, NODE_FIELDS


def to_nodes(trees: DataFrame) -> DataFrame:
    """A row for each node of a tree table."""
    return trees.select("doc_id", F.explode("nodes").alias("x")).select("doc_id", "x.*")


def to_trees(nodes: DataFrame) -> DataFrame:
    """A tree table from a node table, nodes in postorder."""
    return nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*NODE_FIELDS))).alias("nodes")).select("doc_id", F.size("nodes").alias("n"), "nodes")


def postorder(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("doc_id", "node_id")


def preorder(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("doc_id", "pre")


def keyroots(nodes: DataFrame) -> DataFrame:
    """The greatest postorder number for each leftmost leaf."""
    return nodes.groupBy("doc_id", "lml").agg(F.max("node_id").alias("keyroot"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == LEAF)


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type") == ELEMENT)


def normalise(trees: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Element labels by their canonical names, one hop, at any depth.

    Aliases are a small mapping known to the driver, so they are a literal of the plan.
    Equal sibling labels may result. Paths and fields follow the new labels.
    """
    if not aliases:
        return trees
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    rename = lambda kind, label: F.when(kind == ELEMENT, F.coalesce(F.try_element_at(names, label), label)).otherwise(label)
    named = F.transform("nodes", lambda x: x.withField("label", rename(x["node_type"], x["label"])))
    by_pre = F.sort_array(F.transform(named, lambda x: F.struct(x["pre"].alias("pre"), x.alias("x"))))
    touched = F.exists("nodes", lambda x: (x["node_type"] == ELEMENT) & F.try_element_at(names, x["label"]).isNotNull())
    step = lambda acc, p: F.concat(
        acc,
        F.array(
            F.struct(
                p["x"]["node_id"].alias("node_id"),
                F.when(p["x"]["depth"] == 0, p["x"]["label"]).otherwise(F.concat_ws("/", F.get(F.filter(acc, lambda a: a["node_id"] == p["x"]["parent_id"]), 0)["path"], p["x"]["label"])).alias("path"),
                F.when(p["x"]["depth"] <= 1, p["x"]["label"]).otherwise(F.get(F.filter(acc, lambda a: a["node_id"] == p["x"]["parent_id"]), 0)["field"]).alias("field"),
            )
        ),
    )
    kind = "array<struct<node_id:int,path:string,field:string>>"
    paths = F.sort_array(F.aggregate(by_pre, F.array().cast(kind), step))
    rebuilt = F.zip_with(named, paths, lambda x, p: x.withField("path", p["path"]).withField("field", p["field"]))
    return trees.withColumn("nodes", F.when(touched, rebuilt).otherwise(F.col("nodes")))


def _text(x: Column) -> Column:
    """A node's text, from the array that it is in.

    A leaf is its label. Else children join by ``; ``: a leaf as its label, an element with
    leaves as ``label: a, b``, any other as ``[label]``; without children the element says
    so itself. A node's descendants stand before it in the array, siblings in order.
    """
    children = lambda y: F.filter(F.slice(F.col("nodes"), y["lml"], y["subtree_size"]), lambda z: z["parent_id"] == y["node_id"])
    items = lambda y: F.transform(F.filter(children(y), lambda z: z["node_type"] == LEAF), lambda z: z["label"])
    element = lambda y: F.when(F.size(items(y)) > 0, F.concat(y["label"], F.lit(": "), F.array_join(items(y), ", "))).otherwise(F.concat(F.lit("["), y["label"], F.lit("]")))
    shown = F.transform(children(x), lambda y: F.when(y["node_type"] == LEAF, y["label"]).otherwise(element(y)))
    alone = F.concat(F.lit("["), x["label"], F.lit(" element with 0 children]"))
    return F.when(x["node_type"] == LEAF, x["label"]).when(x["subtree_size"] > 1, F.array_join(shown, "; ")).otherwise(alone)


def node_texts(trees: DataFrame) -> DataFrame:
    """``doc_id``, ``node_id`` and the text of each node, each tree in its own row."""
    made = F.transform("nodes", lambda x: F.struct(x["node_id"].alias("node_id"), _text(x).alias("text")))
    return trees.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


def fields(trees: DataFrame) -> DataFrame:
    """The children of the roots: ``doc_id``, ``child_pos``, ``label``, ``node_type``,
    ``child_count`` and ``text``, each tree in its own row."""
    count = lambda x: F.size(F.filter("nodes", lambda y: y["parent_id"] == x["node_id"])).cast("long")
    made = F.transform(F.filter("nodes", lambda x: x["depth"] == 1), lambda x: F.struct(x["child_pos"].alias("child_pos"), x["label"].alias("label"), x["node_type"].alias("node_type"), count(x).alias("child_count"), _text(x).alias("text")))
    return trees.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


def leaf_texts(trees: DataFrame) -> DataFrame:
    """``doc_id``, ``node_id``, ``leaf_text``: the non-empty leaves below each node, joined.

    A node's leaves are those whose numbers lie between its leftmost leaf's and its own,
    which one row of a tree table has at hand.
    """
    inside = lambda x: F.slice(F.col("nodes"), x["lml"], x["subtree_size"])
    text = lambda x: F.array_join(F.transform(F.filter(inside(x), lambda y: (y["node_type"] == LEAF) & (y["label"] != "")), lambda y: y["label"]), " ")
    made = F.transform("nodes", lambda x: F.struct(x["node_id"].alias("node_id"), text(x).alias("leaf_text")))
    return trees.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*")


def summary(trees: DataFrame) -> DataFrame:
    """For each tree: size, elements, leaves, and the labels below the root in order."""
    return trees.select(
        "doc_id",
        F.col("n").cast("long").alias("n_nodes"),
        F.size(F.filter("nodes", lambda x: x["node_type"] == ELEMENT)).cast("long").alias("n_elements"),
        F.size(F.filter("nodes", lambda x: x["node_type"] == LEAF)).cast("long").alias("n_leaves"),
        F.array_join(F.transform(F.filter("nodes", lambda x: x["depth"] == 1), lambda x: x["label"]), ",").alias("top_labels"),
    )
