"""Edit scripts from mappings, by expressions over one row; counts, previews and texts.

The order is fixed: relabels by postorder of the source, deletions by postorder of the
source, insertions by preorder of the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.model import LEAF
from treeloom.sources.config import CostModel

#: Columns of an operation; src and dst numbers say what patching needs to know.
OP = ["op_type", "cost", "src_node", "dst_node", "label", "node_type", "new_label", "new_type", "path", "parent_path", "parent_label", "position", "src_parent", "field", "src_pre", "src_size", "src_depth", "dst_pre", "dst_size", "dst_depth", "src_attribute", "dst_attribute"]


def _op(kind: str, cost: Column, a: Column | None, b: Column | None, **more: Column) -> Column:
    """An operation on source node ``a`` and target node ``b``."""
    null = lambda t: F.lit(None).cast(t)
    of = lambda x, k, t: x[k] if x is not None else null(t)
    own = a if a is not None else b
    values = {
        "op_type": F.lit(kind), "cost": cost.cast("double"), "src_node": of(a, "node_id", "int"), "dst_node": of(b, "node_id", "int"), "label": own["label"], "node_type": own["node_type"],
        "new_label": b["label"] if kind == "relabel" else null("string"), "new_type": b["node_type"] if kind == "relabel" else null("string"), "path": own["path"],
        "parent_path": null("string"), "parent_label": null("string"), "position": null("int"), "src_parent": null("int"), "field": own["field"],
        "src_pre": of(a, "pre", "int"), "src_size": of(a, "subtree_size", "int"), "src_depth": of(a, "depth", "int"), "dst_depth": of(b, "depth", "int"), "dst_pre": of(b, "pre", "int"), "dst_size": of(b, "subtree_size", "int"),
        "src_attribute": of(a, "attribute", "boolean"), "dst_attribute": of(b, "attribute", "boolean"),
    } | more
    return F.struct(*(values[k].alias(k) for k in OP))


def with_ops(matched: DataFrame, costs: CostModel | dict | None = None) -> DataFrame:
    """Pairs with trees and mapping, with their operations in an array ``ops``."""
    model = CostModel.of(costs)
    a = lambda i: F.get(F.col("src_nodes"), i - 1)
    b = lambda j: F.get(F.col("dst_nodes"), j - 1)
    size = lambda s: F.greatest(F.coalesce(F.size(f"{s}_nodes"), F.lit(0)), F.lit(0))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    text, structure = model.relabel_prices("nierman_jagadish")
    price = lambda x, y: F.when(F.col("algorithm") == "chawathe", float(model.relabel)).when((x["node_type"] == LEAF) & (y["node_type"] == LEAF), float(text)).otherwise(float(structure))
    changed = F.filter(F.col("matched"), lambda m: a(m["i"])["label"] != b(m["j"])["label"])
    relabels = F.transform(changed, lambda m: _op("relabel", price(a(m["i"]), b(m["j"])), a(m["i"]), b(m["j"])))
    gone = F.array_except(numbers(size("src")), F.transform("matched", lambda m: m["i"]))
    deletes = F.transform(F.sort_array(gone), lambda i: _op("delete", F.lit(model.delete), a(i), None))
    new = F.array_except(numbers(size("dst")), F.transform("matched", lambda m: m["j"]))
    ordered = F.sort_array(F.transform(new, lambda j: F.struct(b(j)["pre"].alias("pre"), j.alias("j"))))
    # Sources of matched targets: a map, looked up for the parents of new nodes only.
    parent = lambda j: b(b(j)["parent_id"])
    source = lambda j: F.get(F.filter("matched", lambda m: m["j"] == b(j)["parent_id"]), 0)["i"]
    inserts = F.transform(
        ordered,
        lambda x: _op("insert", F.lit(model.insert), None, b(x["j"]), parent_path=F.coalesce(parent(x["j"])["path"], F.lit("")), parent_label=parent(x["j"])["label"], position=b(x["j"])["child_pos"], src_parent=source(x["j"])),
    )
    return matched.withColumn("ops", F.concat(relabels, deletes, inserts))


def edit_ops(scripts: DataFrame) -> DataFrame:
    """A row for each operation: the pair, ``op_seq`` (from 1) and the operation."""
    return scripts.select("src", "dst", "algorithm", F.posexplode("ops").alias("k", "op")).select("src", "dst", "algorithm", (F.col("k") + 1).alias("op_seq"), "op.*")


def op_counts() -> dict[str, Column]:
    """Columns of a row's ``ops``: how many of each kind (0 if none), all, their total cost."""
    number = lambda kind: F.size(F.filter("ops", lambda x: x["op_type"] == kind)).cast("long")
    cost = F.aggregate("ops", F.lit(0.0), lambda acc, x: acc + x["cost"])
    return {**{f"{kind}s": number(kind) for kind in ("insert", "delete", "relabel")}, "total_ops": F.size("ops").cast("long"), "total_cost": cost}


def counted(scripts: DataFrame) -> DataFrame:
    """For each pair: operations of each kind (0 if none), all, and their total cost."""
    return scripts.select("src", "dst", "algorithm", "ted", *(c.alias(k) for k, c in op_counts().items()))


def preview(scripts: DataFrame, first: int = 10) -> DataFrame:
    """The first operations of each pair, in script order, labels cut to 40 characters."""
    rows = edit_ops(scripts.withColumn("ops", F.slice("ops", 1, first)))
    return rows.select("src", "dst", "op_seq", "op_type", F.substring("label", 1, 40).alias("label"), F.substring("new_label", 1, 40).alias("new_label"), "cost")


def script_text(scripts: DataFrame) -> DataFrame:
    """The script as text: a head with number and cost, then a numbered line each."""
    line = lambda x, k: F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), F.upper(x["op_type"]), F.lit(" "), x["label"], F.coalesce(F.concat(F.lit(" -> "), x["new_label"]), F.lit("")), F.lit(" (cost="), _plain(x["cost"]), F.lit(")"))
    cost = F.aggregate("ops", F.lit(0.0), lambda acc, x: acc + x["cost"])
    head = F.concat(F.lit("EditScript — "), F.size("ops").cast("string"), F.lit(" ops, cost="), _plain(cost))
    return scripts.select("src", "dst", F.array_join(F.concat(F.array(head), F.transform("ops", line)), "\n").alias("script"))


def _plain(x: Column) -> Column:
    """A number without a fraction as a whole one."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def inverted(scripts: DataFrame, costs: CostModel | dict | None = None) -> DataFrame:
    """The scripts from target to source: kinds, labels, types and numbers change sides."""
    model = CostModel.of(costs)
    swap = {"src_node": "dst_node", "dst_node": "src_node", "src_pre": "dst_pre", "dst_pre": "src_pre", "src_size": "dst_size", "dst_size": "src_size", "src_depth": "dst_depth", "dst_depth": "src_depth", "src_attribute": "dst_attribute", "dst_attribute": "src_attribute"}
    back = lambda x: F.struct(
        *(
            {
                "op_type": F.when(x["op_type"] == "insert", "delete").when(x["op_type"] == "delete", "insert").otherwise("relabel"),
                "cost": F.when(x["op_type"] == "insert", float(model.delete)).when(x["op_type"] == "delete", float(model.insert)).otherwise(x["cost"]),
                "label": F.coalesce(x["new_label"], x["label"]),
                "node_type": F.coalesce(x["new_type"], x["node_type"]),
                "new_label": F.when(x["op_type"] == "relabel", x["label"]),
                "new_type": F.when(x["op_type"] == "relabel", x["node_type"]),
            }.get(k, x[swap.get(k, k)]).alias(k)
            for k in OP
        )
    )
    swapped = scripts.withColumns({"src": F.col("dst"), "dst": F.col("src"), "src_nodes": F.col("dst_nodes"), "dst_nodes": F.col("src_nodes")})
    return swapped.withColumn("ops", F.transform("ops", back))
