"""Trees from tables, built by expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.model import ELEMENT, LEAF


def _node(node_id, pre, parent, pos, depth, label, kind, size, path, field) -> Column:
    i = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(
        i(node_id).alias("node_id"), i(pre).alias("pre"), i(parent).alias("parent_id"), i(pos).alias("child_pos"), i(depth).alias("depth"), label.alias("label"), F.lit(kind).alias("node_type"),
        i(size).alias("subtree_size"), (i(node_id) - i(size) + 1).alias("lml"), path.alias("path"), field.alias("field"), F.lit(False).alias("attribute"),
    )


def from_fields(df: DataFrame, doc_id: str | Column, root: str, fields: Column) -> DataFrame:
    """Trees of a root and an element with one leaf for each field.

    ``fields`` is an array of structs (key, value), in order; those with a null value are
    left out. Postorder numbers of such trees are arithmetic: the k-th field has 2k - 1
    and 2k, the root comes last.
    """
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = df.select(doc.cast("string").alias("doc_id"), F.filter(fields, lambda x: x["value"].isNotNull()).alias("fields"))
    n = F.size("fields") * 2 + 1
    pair = lambda x, k: F.array(
        _node(2 * k + 1, 2 * k + 3, 2 * k + 2, 0, 2, x["value"], LEAF, 1, F.concat_ws("/", F.lit(root), x["key"], x["value"]), x["key"]),
        _node(2 * k + 2, 2 * k + 2, n, k, 1, x["key"], ELEMENT, 2, F.concat_ws("/", F.lit(root), x["key"]), x["key"]),
    )
    top = _node(n, 1, F.lit(None), 0, 0, F.lit(root), ELEMENT, n, F.lit(root), F.lit(root))
    return rows.select("doc_id", n.cast("int").alias("n"), F.concat(F.flatten(F.transform("fields", pair)), F.array(top)).alias("nodes"))


def from_items(df: DataFrame, doc_id: str | Column, root: str | Column, items: Column) -> DataFrame:
    """Flat trees: a root, named by a string or a column, with a leaf for each string of the
    array ``items``."""
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    rows = df.select(doc.cast("string").alias("doc_id"), items.alias("items"), (root if isinstance(root, Column) else F.lit(root)).alias("root"))
    n, name = F.size("items") + 1, F.col("root")
    leaves = F.transform("items", lambda x, k: _node(k + 1, k + 2, n, k, 1, x, LEAF, 1, F.concat_ws("/", name, x), x))
    top = _node(n, 1, F.lit(None), 0, 0, name, ELEMENT, n, name, name)
    return rows.select("doc_id", n.cast("int").alias("n"), F.concat(leaves, F.array(top)).alias("nodes"))
