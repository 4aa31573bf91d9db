"""Variable-capacity best-fit packing (operator 1).

Documents become sequences of several permitted lengths. Pieces go, longest first, into
the open bin that they leave least room in; where none has room, a new bin opens whose
length costs least for each token that the remaining pieces would fill it with; at the
end each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import WORD, checkpointed

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence besides its tokens, in tokens.
OVERHEAD = 32
#: Pieces are dealt by hash over shards of about so many; each is packed by one task, which
#: leaves a few partly filled bins a shard.
PIECES_A_SHARD = 100_000


class _Bits:
    """Counted lengths, with the next one up or down in a word of bits."""

    def __init__(self) -> None:
        self.mask = 0
        self.count: dict[int, int] = {}

    def add(self, n: int, k: int = 1) -> None:
        self.count[n] = self.count.get(n, 0) + k
        self.mask |= 1 << n

    def remove(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def at_least(self, n: int) -> int:
        """The least length of n or more, or -1."""
        up = self.mask >> n
        return n + (up & -up).bit_length() - 1 if up else -1

    def at_most(self, n: int) -> int:
        """The greatest length of n or less, or -1."""
        return (self.mask & (1 << n + 1) - 1).bit_length() - 1


def _filled(left: _Bits, room: int) -> int:
    """Tokens that the remaining pieces would put into ``room``, longest first."""
    total, used = 0, {}
    n = left.at_most(room)
    while n > 0:
        k = min(room // n, left.count[n] - used.get(n, 0))
        if k > 0:
            used[n] = used.get(n, 0) + k
            total += k * n
            room -= k * n
        n = left.at_most(min(room, n - 1))
    return total


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing over ``sizes`` (each from 1 to the greatest length).

    Returns for each piece its bin and its offset there, and for each bin its capacity.
    Ties go to the piece given first, the bin opened first and the shorter length.
    """
    lengths = tuple(sorted(lengths))
    left, open_bins = _Bits(), _Bits()
    for n in sizes:
        left.add(n)
    bins_of: dict[int, list[int]] = {}  # by room, ascending
    used: list[int] = []
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        left.remove(n)
        room = open_bins.at_least(n)
        if room >= 0:
            k = bins_of[room].pop(0)
            open_bins.remove(room)
        else:
            k = len(used)
            used.append(0)
            room = min(lengths[bisect_left(lengths, n) :], key=lambda c: ((c + overhead) / (n + _filled(left, c - n)), c))
        where[i], offset[i] = k, used[k]
        used[k] += n
        if room > n:
            open_bins.add(room - n)
            stack = bins_of.setdefault(room - n, [])
            stack.insert(bisect_left(stack, k), k)
    return where, offset, [lengths[bisect_left(lengths, n)] for n in used]


_SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long, bin_tokens long, bin_length long"


def pack_documents(df: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", *, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, pieces_a_shard: int = PIECES_A_SHARD) -> DataFrame:
    """A row for each piece of each document: where it begins, and its place in a bin.

    A document longer than the greatest length is cut into pieces of that length and a
    rest; the pieces cover it exactly. A document without tokens (size null or 0) has one
    piece of 0 tokens in no bin (``bin_id`` null). Repeated rows are packed as often as
    they come, rows with a null id as well. The result depends on the rows alone, not on
    their order or partitions. Other columns are not read.
    """
    most = max(lengths)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size"))
    # Equal rows are counted before they are dealt, so that no group of them meets in a shard.
    rows = rows.groupBy("doc_id", "size").count().select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    pieces = rows.select("doc_id", "copy", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / most) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.col("size") - F.col("piece").cast("long") * most, F.lit(most)).cast("long").alias("n_tokens"))
    number = df.agg((F.count(F.lit(1)) + F.coalesce(F.sum(F.floor(F.col(size_col).cast("double") / most)), F.lit(0))).alias("n")).first()["n"]
    shards = max(1, -(-int(number) // pieces_a_shard))
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece"), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], na_position="first", kind="stable")
        where, offset, capacity = pack(rows["n_tokens"].tolist(), lengths, overhead)
        shard = int(rows["shard"].iloc[0])
        out = rows[["doc_id", "piece", "start", "n_tokens"]].copy()
        out["bin_id"] = [(shard << 32) + k for k in where]
        out["bin_offset"] = offset
        out["bin_tokens"] = out.groupby("bin_id")["n_tokens"].transform("sum")
        out["bin_length"] = [capacity[k] for k in where]
        return out

    packed = dealt.groupBy("shard").applyInPandas(run, _SCHEMA)
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece", "start", F.lit(0).cast("long").alias("n_tokens"), *[F.lit(None).cast("long").alias(x) for x in ("bin_id", "bin_offset", "bin_tokens", "bin_length")])
    return packed.unionByName(none)


def words(text_col: str = "text"):
    """The number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0))


def op1(docs: DataFrame) -> DataFrame:
    """All ``documents`` packed by their number of words."""
    return pack_documents(checkpointed(docs.select("doc_id", words().alias("n_tokens"))))
