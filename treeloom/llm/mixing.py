"""Mixing sources to target weights by weighted fair queueing (operator 6).

The documents of each source stand in a shuffled queue, passed through several times if
need be. An entry's virtual finish time is its source's cumulative tokens divided by the
source's target. All entries are sorted by finish time over ranges of it, and the mix
ends where the tokens reach the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.llm.common import checkpointed, ranked
from treeloom.llm.packing import words

#: Rows of one range of a queue or of virtual time, on average.
ROWS_A_RANGE = 2_000
MAX_PASSES = 3


def targets(sizes: DataFrame, *, share: float = 1.0, max_passes: int = MAX_PASSES, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from a table of ``source`` and ``size``.

    Sources in code-point order, null last, weigh the given weights in turn. They share
    ``share`` of all sizes; no target passes ``max_passes`` times its source's size, and
    what is cut off goes to the others by weight, until none is above. A source without
    tokens has target 0. An empty table gives an empty one.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    table = checkpointed(ranked(by_source, F.col("source").asc_nulls_last(), name="place").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_passes)).alias("most")))
    budget = (table.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level, capped = 0.0, -1
    while True:  # each round caps more sources, or is the last
        open_ = F.col("most") > F.col("weight") * level
        row = table.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, F.col("most"))).alias("m"), F.count_if(~open_).alias("k")).first()
        if row["k"] == capped or not row["w"]:
            break
        level, capped = (budget - (row["m"] or 0.0)) / row["w"], row["k"]
    return table.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", *, share: float = 1.0, max_passes: int = MAX_PASSES, weights: tuple[int, ...] = (1, 2, 3), rows_a_range: int = ROWS_A_RANGE, plan: DataFrame | None = None) -> DataFrame:
    """The entries of the mix: document, source, pass (from 0), virtual finish time, place in
    tokens, and the tokens taken.

    Sizes of null count as 0; entries without tokens take nothing and are left out. The
    entry that crosses the budget is taken whole if that brings the total nearer to it.
    Equal rows are entries of their own. The result depends on the rows alone: queues are
    shuffled by a hash of the id, the place among equal rows decides ties.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    plan = plan if plan is not None else targets(rows, share=share, max_passes=max_passes, weights=weights)
    total = plan.agg(F.sum("target").alias("t"), F.sum("source_size").alias("n")).first()
    budget = total["t"] or 0.0
    # Equal rows are counted, so that no group of them meets in a range of the queue.
    counted = rows.where("size > 0").groupBy("doc_id", "source", "size").count()
    queue = counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy")).withColumn("h", F.xxhash64("doc_id", "copy"))
    number = rows.count()
    ranges = max(1, -(-number // rows_a_range))
    queue = queue.alias("a").join(plan.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "b.target")
    # The hash is uniform, so ranges of it cut each source's queue evenly. A document of more
    # than twice its source's target stands behind the rest, as it would never be taken.
    queue = queue.withColumn("cut", F.when(F.col("size") > 2 * F.col("target"), ranges).otherwise(F.floor((F.col("h") / float(1 << 64) + 0.5) * ranges)))
    sums = queue.groupBy("source", "cut").agg(F.sum("size").alias("n"))
    usable = F.sum(F.when(F.col("cut") < ranges, F.col("n")).otherwise(0)).over(Window.partitionBy("source"))
    before = sums.select("source", "cut", (F.sum("n").over(Window.partitionBy("source").orderBy("cut")) - F.col("n")).alias("before"), usable.alias("usable"))
    same = F.expr("a.source <=> b.source AND a.cut = b.cut")
    placed = queue.where(F.col("cut") < ranges).alias("a").join(before.alias("b"), same).select("a.*", "b.before", "b.usable")
    inside = Window.partitionBy("source", "cut").orderBy("h", "doc_id", "copy", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("through", F.col("before") + F.sum("size").over(inside)).select("doc_id", "source", "size", "copy", "h", "through", "target", "usable")
    entries = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass"))
    entries = entries.withColumn("finish", (F.col("pass") * F.col("usable") + F.col("through")) / F.col("target"))
    # Every source is due to end at time 1. An entry that ends after 2 would alone take its
    # source further past its target than leaving it out leaves it short.
    entries = entries.where("finish <= 2").withColumn("slot", F.floor(F.col("finish") * ranges))
    upto = _running(entries.groupBy("slot").agg(F.sum("size").alias("n")))
    kept = entries.join(upto, "slot").where(F.col("start") < budget)
    order = Window.partitionBy("slot").orderBy("finish", "h", "doc_id", "copy", "pass", "source").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("end", F.col("start") + F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    return kept.where(F.col("end") - budget <= budget - F.col("start")).select("doc_id", "source", "size", "target", "copy", "pass", "finish", "start", F.col("size").alias("taken"))


def _running(slots: DataFrame) -> DataFrame:
    """The tokens before each slot: by blocks of slots, whose few sums one task can order."""
    blocks = slots.withColumn("block", F.floor(F.col("slot") / 1000))
    heads = blocks.groupBy("block").agg(F.sum("n").alias("m"))
    heads = heads.select("block", (F.sum("m").over(Window.orderBy("block")) - F.col("m")).alias("head"))
    return blocks.join(heads, "block").select("slot", (F.col("head") + F.sum("n").over(Window.partitionBy("block").orderBy("slot")) - F.col("n")).alias("start"))


def op6(docs: DataFrame) -> DataFrame:
    """Words that the mix takes of each of all ``documents``, repeats counted."""
    sized = checkpointed(docs.select("doc_id", "source", words().alias("size")))
    plan = targets(sized)
    entries = mix(sized, plan=plan)
    # Equal rows share what the mix takes of them, as evenly as whole passes allow.
    taken = entries.groupBy("doc_id", "source", "size", "copy").agg(F.sum("taken").alias("taken"))
    rows = sized.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    out = rows.alias("a").join(taken.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.source <=> b.source AND a.size = b.size AND a.copy = b.copy"), "left").select("a.doc_id", "a.source", "a.size", F.coalesce("b.taken", F.lit(0)).alias("taken"))
    return out.alias("a").join(plan.alias("b"), F.expr("a.source <=> b.source")).select("a.doc_id", "a.source", "a.size", "b.source_size", "b.target", "a.taken")
