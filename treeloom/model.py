"""The data model: rooted ordered labelled trees as tables.

A *node table* has a row for each node. A *tree table* has a row for each tree, with its
nodes in an array by postorder number, which lets most operators work on one row without a
shuffle. Both say the same; :mod:`treeloom.operators.nodes` turns one into the other.
"""

from __future__ import annotations

from pyspark.sql import types as T

ELEMENT, LEAF = "element", "leaf"

NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),  # postorder, from 1
        T.StructField("pre", T.IntegerType()),  # preorder, from 1
        T.StructField("parent_id", T.IntegerType()),  # null at the root
        T.StructField("child_pos", T.IntegerType()),  # among its siblings, from 0
        T.StructField("depth", T.IntegerType()),  # 0 at the root
        T.StructField("label", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("subtree_size", T.IntegerType()),
        T.StructField("lml", T.IntegerType()),  # leftmost leaf of its subtree
        T.StructField("path", T.StringType()),  # labels from the root, joined by /
        T.StructField("field", T.StringType()),  # label below the root that it belongs to
        T.StructField("attribute", T.BooleanType()),  # whether it was an XML attribute
    ]
)
NODE_FIELDS = NODE.fieldNames()
TREE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("nodes", T.ArrayType(NODE))])

#: Algorithms are cost models of one distance: one price for any relabel, or one for text
#: (leaf to leaf) and one for structure.
ALGORITHMS = ("chawathe", "nierman_jagadish")
STRATEGIES = ("single_node", "token_nodes")


def checked_algorithm(name: str) -> str:
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}: choose one of {', '.join(ALGORITHMS)}")
    return name
