"""Applying edit scripts.

A deletion moves the node's children up into its place, and an insertion takes the nodes
it covers as its children, as the distance counts them; so one pass gives the target. Kept
nodes stay in order, inserted ones stand at their preorder numbers in the target, and a
node's new depth is its old one, less its deleted ancestors, plus its inserted ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from treeloom.model import ELEMENT, NODE
from treeloom.operators.distance import PAIRS_AT_ONCE, distances, measured
from treeloom.operators.script import with_ops
from treeloom.sources.config import CostModel
from treeloom.sources.xml import numbered


def patched(nodes: list[dict], ops: list[dict]) -> list[tuple]:
    """Node rows of the tree after all operations; the input is not changed.

    Operations on nodes that are not there have no effect. If no node is left, or several
    are left without a parent, a root with an empty label stands above what there is.
    """
    deleted = {x["src_node"] for x in ops if x["op_type"] == "delete"}
    renamed = {x["src_node"]: x for x in ops if x["op_type"] == "relabel"}
    inserted = sorted((x for x in ops if x["op_type"] == "insert"), key=lambda x: x["dst_pre"])
    kept: list[list] = []
    ends: list[int] = []  # where the subtrees of deleted ancestors end
    for x in sorted(nodes, key=lambda x: x["pre"]):
        while ends and x["pre"] >= ends[-1]:
            ends.pop()
        if x["node_id"] in deleted:
            ends.append(x["pre"] + x["subtree_size"])
        else:
            change = renamed.get(x["node_id"])
            kept.append([change["new_label"], change["new_type"], bool(change.get("dst_attribute"))] if change else [x["label"], x["node_type"], x["attribute"]])
            kept[-1].append(x["depth"] - len(ends))
    ends, k, root = [], 0, []
    above: list[tuple[int, list]] = [(-1, root)]  # depth and children of the open nodes

    def put(label: str, kind: str, attribute: bool, depth: int) -> None:
        while above[-1][0] >= max(depth, 0):
            above.pop()
        node = (label, kind, [], attribute)
        above[-1][1].append(node)
        above.append((depth, node[2]))

    place = 1
    for x in [*inserted, None]:
        while k < len(kept) and (x is None or place < x["dst_pre"]):
            while ends and place >= ends[-1]:
                ends.pop()
            label, kind, attribute, depth = kept[k]
            put(label, kind, attribute, depth + len(ends))
            place, k = place + 1, k + 1
        if x:
            while ends and place >= ends[-1]:
                ends.pop()
            put(x["label"], x["node_type"], bool(x.get("dst_attribute")), x["dst_depth"])
            ends.append(place + x["dst_size"])
            place += 1
    return numbered(root[0] if len(root) == 1 else ("", ELEMENT, root, False))


#: What patching reads of nodes and of operations.
_OF_NODES = ("node_id", "pre", "subtree_size", "depth", "label", "node_type", "attribute")
_OF_OPS = ("op_type", "src_node", "label", "node_type", "new_label", "new_type", "dst_pre", "dst_size", "dst_depth", "dst_attribute")


def _patch() -> Column:
    """The node array of the patched source, from ``src_nodes`` and ``ops``."""
    kind = to_arrow_schema(T.StructType([T.StructField("nodes", T.ArrayType(NODE))])).field(0).type

    def rows(values: pa.Array, names: tuple[str, ...]) -> list[list[dict]]:
        return [[dict(zip(names, x)) for x in zip(*each)] if each[0] else [] for each in zip(*(values.field(k).to_pylist() for k in names))]

    def run(trees: pa.Array, ops: pa.Array) -> pa.Array:
        sizes, every = [0], []
        for at in range(0, len(trees), PAIRS_AT_ONCE):
            for nodes, script in zip(rows(trees.slice(at, PAIRS_AT_ONCE), _OF_NODES), rows(ops.slice(at, PAIRS_AT_ONCE), _OF_OPS)):
                made = patched(nodes, script)
                sizes.append(len(made))
                every += made
        columns = zip(*every) if every else [[] for _ in NODE]
        fields = [pa.array(list(x), f.type) for x, f in zip(columns, kind.value_type)]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))

    run.__annotations__ = {"trees": pa.Array, "ops": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, T.ArrayType(NODE)).asNondeterministic()
    slim = lambda c, names: F.struct(*(F.col(c)[k].alias(k) for k in names))
    return udf(slim("src_nodes", _OF_NODES), slim("ops", _OF_OPS))


def apply(scripts: DataFrame) -> DataFrame:
    """The scripts with the patched sources as ``nodes`` and their sizes ``n``.

    Null sources are patched as trees without nodes. All other columns stay, so the row
    still has its target; repeated pairs stay apart.
    """
    return scripts.withColumn("nodes", _patch()).withColumn("n", F.size("nodes"))


def _unlike(a: str, b: str) -> Column:
    """Whether two trees differ in labels or shape."""
    form = lambda c: F.transform(c, lambda x: F.struct(x["label"], x["subtree_size"]))
    return ~F.coalesce(form(a), F.array().cast("array<struct<label:string,subtree_size:int>>")).eqNullSafe(F.coalesce(form(b), F.array().cast("array<struct<label:string,subtree_size:int>>")))


def residual(scripts: DataFrame, costs: CostModel | dict | None = None) -> DataFrame:
    """The patched scripts with ``residual``: the distance (one relabel price, whatever
    priced the script) from the patched source to its target; 0 is a perfect patch.

    A patched source that equals its target skips the kernel.
    """
    made = apply(scripts).withColumn("__unlike", _unlike("nodes", "dst_nodes"))
    rest = lambda c: F.when(F.col("__unlike"), F.col(c))
    return made.withColumn("residual", measured(CostModel.of(costs), "chawathe", matched=False)(rest("nodes"), rest("dst_nodes"))).drop("__unlike")


def refined(scripts: DataFrame, costs: CostModel | dict | None = None, max_rounds: int = 5) -> DataFrame:
    """``src``, ``dst``, ``residual`` and the ``rounds`` of patching that were made.

    Where the first round leaves a rest (its script was not whole), a second one patches by
    a whole script of what is left, which is exact: so rounds are 1 or 2, however many more
    are allowed, and 1 if no more are.
    """
    if max_rounds < 1:
        raise ValueError("max_rounds must be 1 or more")
    first = residual(scripts, costs).select("src", "dst", "nodes", "dst_nodes", "residual")
    if max_rounds == 1:
        return first.select("src", "dst", "residual", F.lit(1).alias("rounds"))
    left = lambda c: F.when(F.col("residual") != 0, F.col(c)).alias(c)
    again = first.select("src", "dst", (F.col("residual") != 0).alias("again"), left("nodes").alias("src_nodes"), left("dst_nodes"))
    second = residual(with_ops(distances(again, costs), costs), costs)
    return second.select("src", "dst", F.when(F.col("again"), F.col("residual")).otherwise(0.0).alias("residual"), F.when(F.col("again"), 2).otherwise(1).alias("rounds"))
