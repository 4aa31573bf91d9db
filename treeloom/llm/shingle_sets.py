"""Pairs of texts whose sets of five-word shingles are similar (Jaccard 0.8 or more), exactly.

Of a set of n shingles, in any order common to all sets, a similar set has at least one
among the first n - ceil(0.8 n) + 1. Shingles that a sample of the texts shows to be
common come last in the order, so few sets meet at them; the sample moves no result.

Similar sets meet at a number of their first shingles that follows from their sizes, so
sets that meet others at fewer are out before any text is fetched. Links between the rest
are found in two rounds. Where sets meet, the first round pairs each with one of like size
only, so a large group of near copies costs few pairs. The second pairs all of like size
that still lie in different components. Of either, those are compared that come at as many
first shingles as similar sets must meet at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed, shuffle_partitions, string_column
from treeloom.llm.components import components

SHINGLE = 5
SEED = 42
#: Texts of the sample that tells common shingles, and how many of those are told at most.
SAMPLED = 4096
COMMON = 200_000
#: Pairs that are made at a time.
PAIRS = 1 << 16


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's different word shingles, ascending as signed longs.

    Words are those of ``simhash.fingerprint``; a text of fewer words than a shingle is one
    shingle, one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    width = min(width, len(words))
    first, last = (ends - lengths + 1)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first)).view(np.int64))


def _least(n):
    """The least overlap of a set of n with a similar one."""
    return (4 * n + 4) // 5


def _meetings(less, more):
    """At how many of their first shingles similar sets of these sizes meet at least.

    Shingles in common that are not first ones of both are all among the others of the set
    whose first ones end sooner in the order.
    """
    return (4 * (less + more) + 8) // 9 - (_least(more) - 1)


def common_shingles(texts: DataFrame, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one text of a sample has, ascending, and how many have them."""
    sample = texts if number <= SAMPLED else texts.where(F.pmod(F.xxhash64(F.lit(7), "node"), F.lit(-(-number // SAMPLED))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in string_column(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text))], names=["shingle"])

    counts = sample.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 1")
    rows = counts.orderBy(F.col("count").desc(), "shingle").limit(COMMON).toArrow()
    shingles, often = rows["shingle"].to_numpy(), rows["count"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], often[order]


def _first(found: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, the less common before the more common."""
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.argsort(np.where(common[at] == found, often[at], 0), kind="stable")]
    return found[: len(found) - _least(len(found)) + 1] if len(found) else found


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first, cut only between its values."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [x.to_numpy() for x in batch.columns]
        last = int(np.searchsorted(part[0], part[0][-1]))
        if last or held and held[0][0][0] != part[0][0]:
            yield [np.concatenate(x) for x in zip(*held, [x[:last] for x in part])]
            held = []
        held.append([x[last:] for x in part])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin and end."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that meet others of like size, from rows sorted by token, size and node, and the
    least number of first shingles at which they must meet one of those to be similar."""
    for token, size, node in _whole(batches):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, size, node = token[new], size[new], node[new]
        # Sizes within a token, so that one search finds the like ones of all rows. They must
        # meet at the fewest with those least alike in size, which stand first and last.
        group = np.concatenate([[0], np.cumsum(token[1:] != token[:-1])]) * (int(size.max()) * 2 + 2)
        here, place = group + size, np.arange(len(size))
        first = np.searchsorted(here, group + _least(size))
        last = np.searchsorted(here, group + 5 * size // 4, "right") - 1
        need = np.minimum(np.where(first < place, _meetings(size[first], size), size), np.where(last > place, _meetings(size, size[last]), size))
        many = (first < place) | (last > place)
        if many.any():
            yield _batch([token[many], size[many], node[many], np.maximum(need[many], 1)], ["token", "size", "node", "need"])


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where sets meet, each with the least of like size as its centre, and the number of
    first shingles at which the two must meet to be similar."""
    for token, size, node in _whole(batches):
        us, vs, needs = [], [], []
        begin, end = _runs(token)
        for a, b in zip(begin.tolist(), end.tolist()):
            while a < b - 1:
                stop = a + int(np.searchsorted(4 * size[a:b], 5 * size[a], "right"))
                others = node[a + 1 : stop]
                us.append(np.minimum(others, node[a]))
                vs.append(np.maximum(others, node[a]))
                needs.append(_meetings(size[a], size[a + 1 : stop]))
                a = stop
        if us:
            yield _batch([np.concatenate(us), np.concatenate(vs), np.concatenate(needs)], ["u", "v", "need"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of like size of the sets that meet but lie in different components."""
    names = ["u", "v", "need"]
    out: list[list[np.ndarray]] = []
    held = 0
    for token, all_sizes, all_nodes, all_roots in _whole(batches):
        begin, end = _runs(token)
        differ = np.concatenate([[0], np.cumsum((all_roots[1:] != all_roots[:-1]))])
        for a, b in zip(begin.tolist(), end.tolist()):
            if differ[b - 1] == differ[a]:  # one root
                continue
            size, node, root = all_sizes[a:b], all_nodes[a:b], all_roots[a:b]
            ends = np.searchsorted(4 * size, 5 * size, "right")
            for i in range(len(size) - 1):
                other = np.arange(i + 1, ends[i])
                other = other[root[other] != root[i]]
                if len(other):
                    out.append([np.minimum(node[i], node[other]), np.maximum(node[i], node[other]), _meetings(size[i], size[other])])
                    held += len(other)
                if held > PAIRS:
                    yield _batch([np.concatenate(x) for x in zip(*out)], names)
                    out, held = [], 0
    if out:
        yield _batch([np.concatenate(x) for x in zip(*out)], names)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of ``pairs`` whose sets are similar, by all their shingles."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")).hint("merge"), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")).hint("merge"), "v")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("u", "v")


def _often(pairs: DataFrame) -> DataFrame:
    """The pairs that come as often as they need to."""
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n >= need").select("u", "v")


def roots(texts: DataFrame, linked: DataFrame, number: int) -> DataFrame | None:
    """``node`` and ``root`` of the texts that links join: those given and those of similar sets.

    ``texts`` has ``node``, the same for equal texts only, and ``text``, for ``number`` rows
    about; ``linked`` has links (u, v) of nodes. None if no sets meet often enough, so
    nothing is added.
    """
    spark = texts.sparkSession
    hot = spark.sparkContext.broadcast(common_shingles(texts, number))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x) for x in string_column(batch, "text")]
            tokens = [_first(x, *hot.value) for x in sets]
            each = np.array([len(x) for x in tokens], np.int64)
            size = np.repeat(np.array([len(x) for x in sets], np.int64), each)
            yield _batch([np.concatenate([np.empty(0, np.int64), *tokens]), size, np.repeat(batch.column(0).to_numpy(), each)], ["token", "size", "node"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x) for x in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token", "size", "node")

    rows = "token long, size long, node long"
    met = checkpointed(dealt(texts.select("node", "text").mapInArrow(first, rows)).mapInArrow(_met, rows + ", need long"))
    # Similar sets meet k times where the least number is k or less, for some k.
    needs = met.groupBy("node").agg(F.sort_array(F.collect_list("need")).alias("needs"))
    often = needs.where(F.exists(F.transform("needs", lambda x, i: x <= i + 1), lambda x: x)).select("node")
    met = checkpointed(met.join(often, "node", "left_semi").select("token", "size", "node"))
    nodes = met.select("node").distinct()
    if met.isEmpty():
        return None
    compared = checkpointed(_often(dealt(met).mapInArrow(_centred, "u long, v long, need long")))
    sets = checkpointed(texts.join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).select("node", "text").mapInArrow(whole, "node long, shingles array<long>"))
    linked = checkpointed(linked.unionByName(_similar(compared, sets)))
    found = components(linked)
    placed = met.join(found, "node", "left").select("token", "size", "node", F.coalesce("root", "node").alias("root"))
    pairs = checkpointed(_often(dealt(placed).mapInArrow(_apart, "u long, v long, need long")).join(compared, ["u", "v"], "left_anti"))
    return found if pairs.isEmpty() else components(linked.unionByName(_similar(pairs, sets)))
