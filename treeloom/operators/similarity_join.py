"""All pairs of trees within a distance, pruned before the kernel runs.

With unit costs a mapping with e equal labels costs at least the larger size less e, and e
is at most the number of labels that both trees share. So a pair within ``limit`` shares
at least the larger size less ``limit`` labels. Labels are joined under prefix filtering:
the rarest ``limit + 1`` labels of both trees must have one in common, and small trees,
which may share none, pair by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.operators.distance import distances, with_trees


def candidates(trees: DataFrame, limit: int) -> DataFrame:
    """Pairs (``src`` < ``dst``) whose lower bound is at most ``limit``."""
    labels = trees.where("n IS NOT NULL").select("doc_id", "n", F.explode("nodes.label").alias("label")).groupBy("doc_id", "n", "label").count()
    # The k-th copy of a label counts as a token of its own.
    tokens = labels.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("k"), "label")
    often = tokens.groupBy("label", "k").agg(F.count(F.lit(1)).alias("often"))
    bag = tokens.join(often, ["label", "k"]).groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "label", "k"))).alias("bag"))
    # Slim rows meet: a token, its place and the size. Bags are joined to what is left.
    first = bag.select("doc_id", "n", F.posexplode(F.slice("bag", 1, limit + 1)).alias("at", "token"))
    near = f"a.doc_id < b.doc_id AND abs(a.n - b.n) <= {limit}"
    shared = first.alias("a").join(first.alias("b"), F.expr(f"a.token = b.token AND {near} AND greatest(a.n, b.n) - {limit} <= least(a.n - a.at, b.n - b.at)"))
    # Trees of no more nodes than the limit are all within it of each other, so each of
    # these pairs is a result.
    small = bag.where(F.col("n") <= limit).select("doc_id", "n", F.explode(F.sequence(F.greatest(F.col("n") - limit, F.lit(1)), F.lit(limit))).alias("to"))
    by_size = small.alias("a").join(small.where("n = to").alias("b"), F.expr(f"a.to = b.to AND {near}"))
    pair = [F.col("a.doc_id").alias("src"), F.col("b.doc_id").alias("dst")]
    pairs = shared.select(*pair).unionByName(by_size.select(*pair)).distinct()
    side = lambda x: bag.select(F.col("doc_id").alias(x), F.col("n").alias(f"{x}_n"), F.col("bag").alias(f"{x}_bag")).hint("merge")
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    return both.where(F.greatest("src_n", "dst_n") - F.size(F.array_intersect("src_bag", "dst_bag")) <= limit).select("src", "dst")


def within(trees: DataFrame, limit: int) -> DataFrame:
    """Pairs of trees within ``limit`` unit-cost operations: ``src``, ``dst``, ``ted``.

    Equal trees are found by equality of labels and shape and skip the kernel.
    """
    pairs = with_trees(candidates(trees, limit), trees)
    form = lambda s: F.transform(f"{s}_nodes", lambda x: F.struct(x["label"], x["subtree_size"]))
    same = pairs.where(form("src") == form("dst")).select("src", "dst", F.lit(0.0).alias("ted"))
    rest = distances(pairs.where(form("src") != form("dst")), matched=False).select("src", "dst", "ted").where(F.col("ted") <= limit)
    return same.unionByName(rest)
