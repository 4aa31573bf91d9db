"""Tree edit distance of pairs, with the mapping behind it.

The kernel fills the forest distances of pairs of key roots, keeps only the distances of
subtrees, and computes a forest again where the mapping is traced through it. Ties fall to
deleting, then inserting, then matching: a match of two subtrees inside larger forests is
then only taken where it is strictly best, which keeps the mapping one to one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.model import ALGORITHMS, LEAF, checked_algorithm
from treeloom.sources.config import UNIT, CostModel

EPS = 1e-9
#: Pairs of an Arrow batch that are turned into Python values at a time.
PAIRS_AT_ONCE = 256
#: Nodes of the pairs whose results a worker remembers, at most.
REMEMBERED = 1 << 20


class Shape(NamedTuple):
    """A tree for the kernel; lists by postorder number, place 0 unused."""

    labels: list
    leaf: list[bool]
    lml: list[int]

    @property
    def n(self) -> int:
        return len(self.labels) - 1

    def keyroots(self) -> list[int]:
        last = {}
        for i in range(1, self.n + 1):
            last[self.lml[i]] = i
        return sorted(last.values())


def shape(labels: list, types: list[str], lml: list[int]) -> Shape:
    return Shape([None, *labels], [False, *(x == LEAF for x in types)], [0, *lml])


class Distance:
    """Distances between the subtrees of two trees under a cost model."""

    def __init__(self, a: Shape, b: Shape, costs: CostModel = UNIT, algorithm: str = "chawathe"):
        self.a, self.b = a, b
        self.delete, self.insert = float(costs.delete), float(costs.insert)
        text, structure = map(float, costs.relabel_prices(algorithm))
        # Prices of relabels by node of a: a dense row, as most cells look one up.
        self.relabel = [[]] + [[0.0 if a.labels[i] == y else text if a.leaf[i] and b.leaf[j] else structure for j, y in enumerate(b.labels)] for i in range(1, a.n + 1)]
        self.tree = [[0.0] * (b.n + 1) for _ in range(a.n + 1)]
        columns = b.keyroots()
        for i in a.keyroots():
            for j in columns:
                self.forest(i, j, keep=True)

    def forest(self, i: int, j: int, *, keep: bool = False) -> list[list[float]]:
        """Distances of all prefixes of two subtrees' forests. ``keep`` notes those that are
        distances of subtrees."""
        a_lml, b_lml, tree = self.a.lml, self.b.lml, self.tree
        first_a, first_b = a_lml[i], b_lml[j]
        delete, insert = self.delete, self.insert
        width = j - first_b + 2
        above = [c * insert for c in range(width)]
        rows = [above]
        whole = [b_lml[y] == first_b for y in range(first_b, j + 1)]
        jump = [b_lml[y] - first_b for y in range(first_b, j + 1)]
        for x in range(first_a, i + 1):
            value = above[0] + delete
            row = [value]
            known, prices = tree[x], self.relabel[x]
            if a_lml[x] == first_a:
                for c in range(1, width):
                    y = first_b + c - 1
                    value += insert
                    other = above[c] + delete
                    if other < value:
                        value = other
                    if whole[c - 1]:
                        other = above[c - 1] + prices[y]
                        if other < value:
                            value = other
                        if keep:
                            known[y] = value
                    else:
                        other = rows[0][jump[c - 1]] + known[y]
                        if other < value:
                            value = other
                    row.append(value)
            else:
                back = rows[a_lml[x] - first_a]
                for c in range(1, width):
                    value += insert
                    other = above[c] + delete
                    if other < value:
                        value = other
                    other = back[jump[c - 1]] + known[first_b + c - 1]
                    if other < value:
                        value = other
                    row.append(value)
            rows.append(row)
            above = row
        return rows

    @property
    def total(self) -> float:
        return self.tree[self.a.n][self.b.n]

    def mapping(self) -> list[tuple[int, int]]:
        """The matched nodes of both trees, in postorder of the first."""
        out, todo = [], [(self.a.n, self.b.n)]
        while todo:
            i, j = todo.pop()
            rows = self.forest(i, j)
            first_a, first_b = self.a.lml[i], self.b.lml[j]
            r, c = i - first_a + 1, j - first_b + 1
            while r and c:
                x, y = first_a + r - 1, first_b + c - 1
                value = rows[r][c]
                if abs(value - rows[r - 1][c] - self.delete) < EPS:
                    r -= 1
                elif abs(value - rows[r][c - 1] - self.insert) < EPS:
                    c -= 1
                elif self.a.lml[x] == first_a and self.b.lml[y] == first_b:
                    out.append((x, y))
                    r, c = r - 1, c - 1
                else:
                    todo.append((x, y))
                    r, c = self.a.lml[x] - first_a, self.b.lml[y] - first_b
        return sorted(out)


_MATCHED = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


class _Kernel:
    """Distances and mappings of pairs, each kind of pair computed once.

    Both follow from the shapes, and from which labels are equal. So pairs of records that
    one program wrote, of which there are few kinds, cost little more than reading them.
    """

    def __init__(self, costs: CostModel, algorithm: str, matched: bool):
        self.costs, self.algorithm, self.matched = costs, algorithm, matched
        self.known: dict[tuple, tuple[float, np.ndarray]] = {}
        self.held = 0

    def __call__(self, a: tuple, b: tuple) -> tuple[float, np.ndarray]:
        """The distance of two trees, each given by labels, types and leftmost leaves."""
        if not a[0] or not b[0]:
            return float(len(a[0] or ()) * self.costs.delete + len(b[0] or ()) * self.costs.insert), np.empty((0, 2), np.int32)
        names: dict[str, int] = {}
        numbers = tuple(names.setdefault(x, len(names)) for x in (*a[0], *b[0]))
        key = (numbers, tuple(a[1]), tuple(b[1]), tuple(a[2]), tuple(b[2]))
        if (found := self.known.get(key)) is None:
            made = Distance(shape(*a), shape(*b), self.costs, self.algorithm)
            found = (made.total, np.array(made.mapping() if self.matched else [], np.int32).reshape(-1, 2))
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[key] = found
            self.held += len(numbers)
        return found


def measured(costs: CostModel, algorithm: str, *, matched: bool) -> Callable[[Column, Column], Column]:
    """A function of two columns of node arrays: the distance, or a struct of the distance
    ``ted`` and the mapping ``matched``. Null arrays are trees without nodes.

    Only what it needs of the nodes goes to Python. It counts as not deterministic, so
    that no filter on its result makes it run twice.
    """
    kernel = _Kernel(costs, algorithm, matched)
    wanted = ("label", "node_type", "lml")

    def values(trees: pa.Array, at: int) -> list[tuple]:
        part = trees.slice(at, PAIRS_AT_ONCE)
        return list(zip(*(part.field(k).to_pylist() for k in wanted)))

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [kernel(x, y) for at in range(0, len(a), PAIRS_AT_ONCE) for x, y in zip(values(a, at), values(b, at))]
        totals = pa.array([x for x, _ in found], pa.float64())
        if not matched:
            return totals
        ends = np.cumsum([0, *(len(m) for _, m in found)]).astype(np.int32)
        every = np.concatenate([np.empty((0, 2), np.int32), *(m for _, m in found)])
        maps = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["i", "j"]))
        return pa.StructArray.from_arrays([totals, maps], ["ted", "matched"])

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    kind = T.StructType([T.StructField("ted", T.DoubleType()), T.StructField("matched", _MATCHED)]) if matched else T.DoubleType()
    udf = F.arrow_udf(run, kind).asNondeterministic()
    slim = lambda nodes: F.struct(*(nodes[k].alias(k) for k in wanted))
    return lambda a, b: udf(slim(a), slim(b))


def with_trees(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """Pairs (``src``, ``dst``) with both trees as ``src_nodes`` and ``dst_nodes``. Pairs
    of which a document is missing or null stay, with null nodes; repeated pairs stay apart.

    Trees are never broadcast: their arrays are far larger than what a plan estimates.
    """
    side = lambda x: trees.select(F.col("doc_id").alias(x), F.col("nodes").alias(f"{x}_nodes")).hint("merge")
    return pairs.join(side("src"), "src", "left").join(side("dst"), "dst", "left")


def distances(pairs: DataFrame, costs: CostModel | dict | None = None, algorithm: str = "chawathe", *, matched: bool = True) -> DataFrame:
    """Pairs with trees, ``algorithm``, ``ted`` and (if wanted) the mapping ``matched``.

    Where a tree is null, all of the other's nodes are inserted or deleted. Other columns
    pass through; those of the result must not be among them. No row is shuffled.
    """
    checked_algorithm(algorithm)
    if clash := sorted({"algorithm", "ted", "matched"} & {x.lower() for x in pairs.columns}):
        raise ValueError(f"the pairs already have columns {', '.join(clash)}")
    found = measured(CostModel.of(costs), algorithm, matched=matched)(F.col("src_nodes"), F.col("dst_nodes"))
    rows = pairs.select(*pairs.columns, F.lit(algorithm).alias("algorithm"), found.alias("__found"))
    if not matched:
        return rows.withColumnRenamed("__found", "ted")
    return rows.select(*pairs.columns, "algorithm", "__found.ted", "__found.matched")


def similarity(pairs: DataFrame) -> DataFrame:
    """``raw_ted``, ``sim_inverse`` = 1 / (1 + ted), ``sim_ratio`` = 1 - ted / both sizes (1
    for two empty trees; below 0 where costs exceed 1)."""
    size = F.coalesce(F.greatest(F.size("src_nodes"), F.lit(0)), F.lit(0)) + F.coalesce(F.greatest(F.size("dst_nodes"), F.lit(0)), F.lit(0))
    return pairs.withColumns({"raw_ted": F.col("ted"), "sim_inverse": 1 / (1 + F.col("ted")), "sim_ratio": F.when(size == 0, 1.0).otherwise(1 - F.col("ted") / F.nullif(size, F.lit(0)))})


def both_ways(pairs: DataFrame, costs: CostModel | dict | None = None) -> DataFrame:
    """Both algorithms and both directions of each pair, and whether directions differ.

    A row for each pair and algorithm: ``ted_fwd``, ``ted_rv``, ``asymmetric``. All four
    distances are taken in the pair's own row, so repeated pairs and null ids stay apart.
    """
    model = CostModel.of(costs)
    src, dst = F.col("src_nodes"), F.col("dst_nodes")
    rows = pairs.select("src", "dst", *(measured(model, x, matched=False)(*ways).alias(f"{side}_{x}") for x in ALGORITHMS for side, ways in (("fwd", (src, dst)), ("rv", (dst, src)))))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("algorithm"), F.col(f"fwd_{x}").alias("ted_fwd"), F.col(f"rv_{x}").alias("ted_rv")) for x in ALGORITHMS)))
    return rows.select("src", "dst", each.alias("x")).select("src", "dst", "x.*").withColumn("asymmetric", F.abs(F.col("ted_fwd") - F.col("ted_rv")) > EPS)
