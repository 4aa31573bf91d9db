"""XML documents as trees.

Spark's own XML reader needs one schema for all documents and merges repeated siblings, so
order among them is lost; each document is therefore parsed whole, in Arrow batches.
Attributes become leaves ``name=value``, sorted, before other children. An element with
children has no text of its own; any other element's text is one leaf, or a leaf for each
token. Blank text is no leaf.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from treeloom.model import ELEMENT, LEAF, NODE, TREE

TOKENS = re.compile(r"[A-Za-z0-9]+")


def numbered(root: tuple, attributes: frozenset[int] = frozenset()) -> list[tuple]:
    """The node rows of a tree in postorder, from nested (label, type, children, attribute).

    One walk with an explicit stack numbers nodes both ways, so depth is no limit.
    """
    out: list[list] = []
    # A frame: node, preorder number, child position, depth, path, field, postorder
    # numbers of its children, first descendant's number.
    pre = 1
    frames = [[root, pre, 0, 0, root[0], root[0], [], 0]]
    while frames:
        node, at, pos, depth, path, field, done, _ = frame = frames[-1]
        if len(done) < len(node[2]):
            child = node[2][len(done)]
            pre += 1
            frames.append([child, pre, len(done), depth + 1, f"{path}/{child[0]}", child[0] if depth == 0 else field, [], 0])
            continue
        frames.pop()
        number = len(out) + 1
        size = 1 + sum(out[k - 1][7] for k in done)
        out.append([number, at, None, pos, depth, node[0], node[1], size, number - size + 1, path, field, node[3]])
        for k in done:
            out[k - 1][2] = number
        if frames:
            frames[-1][6].append(number)
    return [tuple(x) for x in out]


def parse(xml: str, strategy: str = "single_node") -> list[tuple]:
    """The node rows of one document; malformed XML raises ``ParseError``."""

    def built(element: ET.Element) -> tuple:
        node = (element.tag, ELEMENT, [(f"{k}={v}", LEAF, [], True) for k, v in sorted(element.attrib.items())], False)
        text = (element.text or "").strip()
        if not len(element) and text:
            node[2].extend((x, LEAF, [], False) for x in ([text] if strategy == "single_node" else TOKENS.findall(text)))
        return node

    top = ET.fromstring(xml)
    root = built(top)
    todo = [(top, root)]
    while todo:
        element, node = todo.pop()
        for child in element:
            made = built(child)
            node[2].append(made)
            todo.append((child, made))
    return numbered(root)


def parse_trees(documents: DataFrame, xml: str | Column = "xml", doc_id: str | Column = "doc_id", strategy: str = "single_node") -> DataFrame:
    """A tree table from a table of documents; null and malformed ones give a null tree
    (``n`` null), so that nothing is lost unnoticed."""
    if strategy not in ("single_node", "token_nodes"):
        raise ValueError(f"unknown strategy {strategy!r}")
    col = lambda x: F.col(x) if isinstance(x, str) else x
    rows = documents.select(col(doc_id).cast("string").alias("doc_id"), col(xml).cast("string").alias("xml"))
    names, nodes = NODE.fieldNames(), to_arrow_schema(T.StructType([T.StructField("nodes", T.ArrayType(NODE))])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = []
            for text in batch.column(1).to_pylist():
                try:
                    trees.append(None if text is None else [dict(zip(names, x)) for x in parse(text, strategy)])
                except ET.ParseError:
                    trees.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x and len(x) for x in trees], pa.int32()), pa.array(trees, nodes)], names=["doc_id", "n", "nodes"])

    return rows.mapInArrow(run, TREE)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (file name without suffix), ``name`` (with spaces) and ``xml`` of each file."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.xml$", "").alias("file"), F.col("value").alias("xml"))
    decoded = F.url_decode(F.regexp_replace("file", r"\+", "%2B"))
    return files.select(decoded.alias("doc_id"), F.translate(decoded, "_", " ").alias("name"), "xml")


def read_trees(spark: SparkSession, path: str, strategy: str = "single_node") -> DataFrame:
    return parse_trees(read_documents(spark, path), strategy=strategy)
