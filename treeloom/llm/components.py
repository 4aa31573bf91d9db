"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed

#: A node is a hub if it has more neighbours than this and than a ten-thousandth of the
#: links. So there are at most 20,000 hubs, whatever the number of links.
NEIGHBOURS = 100


def _stars(edges: DataFrame, number: int, *, large: bool) -> DataFrame:
    """Each node's neighbours linked to the least of them and itself.

    Large stars take all neighbours and re-link those above the node; small stars take
    those below it and re-link them and the node. Each of the ``number`` edges (u, v) has
    u > v. Neighbours of hubs learn the least one by a broadcast, which is at most 20,000 rows,
    so that no task gathers a hub's neighbours.
    """
    sides = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if large:
        sides = sides.unionByName(sides.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = sides.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "b").alias("m"), "n")
    many = F.col("n") > max(NEIGHBOURS, number // 10_000)
    hubs = sides.join(F.broadcast(least.where(many).select("a", F.col("m").alias("h"))), "a", "left")
    joined = hubs.where("h IS NULL").drop("h").join(least.where(~many).drop("n"), "a").unionByName(hubs.where("h IS NOT NULL").withColumnRenamed("h", "m"))
    if large:
        linked = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for each node of the links (u, v).

    Loops and repeated links do not matter; nodes without a link to another are left out.
    The rounds grow with the logarithm of the number of nodes. Each is checkpointed.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Stars stand alone when no node is both linked to a lesser one and a root.
        chained = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        twice = edges.groupBy("u").count().where("count > 1")
        if chained.isEmpty() and twice.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        number = edges.count()
        edges = checkpointed(_stars(_stars(edges, number, large=True), number, large=False))
