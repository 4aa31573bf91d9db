"""SimHash near-duplicates by anchor-point covering (operator 10).

Fingerprints of 64 bits link at 3 or fewer differing bits. Such a pair has a half of 32
bits that differs in 1 bit at most. The anchors of a half are the words of a covering
code: 31 bits of the perfect [31, 26] Hamming code and the last bit as it is, so every
half lies within covering radius 1 of an anchor. A fingerprint is at home at the nearest
anchor of each half, and is replicated to every anchor within the covering radius plus 1:
whatever is 1 bit away from a half at home there is among those replicas. Where one is
at home, all that were sent there are compared over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import checkpointed, shuffle_partitions, string_column
from treeloom.llm.components import components

THRESHOLD = 3
SEED = 42
SHINGLE = 3
#: Shingles whose bits are summed at a time.
BLOCK = 1 << 16
#: Pairs of an anchor that are compared at a time.
COMPARED = 1 << 20
#: An anchor of more fingerprints is divided by the bytes of the other half.
DIVIDED = 4096


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words.

    ASCII capitals become small letters; words are divided by ASCII white space; a text of
    fewer words than a shingle is one shingle. Repeated shingles count each time.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    width = min(width, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        part = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id``, kept columns and ``fp``, the fingerprint of the whole text as a signed long."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width, seed) for x in string_column(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


_BITS = np.arange(31)
_PLACES = _BITS + 1  # of the Hamming code, from 1
_PARITY = [np.uint64(sum(1 << int(b) for b in _BITS if _PLACES[b] >> k & 1)) for k in range(5)]
#: For each syndrome but 0, the pairs of places whose exclusive or it is.
_PAIRS = np.array([[0] * 15] + [[(1 << i - 1) | (1 << (i ^ s) - 1) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.uint64)


def syndromes(half: np.ndarray) -> np.ndarray:
    """The place of the bit to flip for the nearest code word, 0 for none."""
    out = np.zeros(len(half), np.int64)
    for k, mask in enumerate(_PARITY):
        out |= (np.bitwise_count(half & mask) & 1).astype(np.int64) << k
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, anchor and whether it is at home there, for every anchor of each fingerprint.

    Anchors are within distance 2 of a half (31 code bits and a plain one) and carry the
    half's number in bit 32.
    """
    index, keys, homes = [], [], []
    every = np.arange(len(fps))
    for side in (0, 1):
        half = fps >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)
        s = syndromes(half)
        flip = np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0)).astype(np.uint64)
        home = half ^ flip
        moved = s > 0
        parts = [(every, home, True), (every, home ^ np.uint64(1 << 31), False)]
        parts += [(every[moved], half[moved] ^ _PAIRS[s[moved], k], False) for k in range(15)]
        for who, anchor, at_home in parts:
            index.append(who)
            keys.append(anchor | np.uint64(side << 32))
            homes.append(np.full(len(who), at_home))
    return np.concatenate(index), np.concatenate(keys).view(np.int64), np.concatenate(homes)


def links_at(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links that span the components of one anchor's fingerprints: fewer than those.

    A component is searched from its first member; each member found is compared once with
    those not found yet, so a group of many near copies costs few comparisons and no pairs.
    """
    if len(fps) <= 64 and np.count_nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= threshold) == len(fps):
        return []
    out, rest = [], fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            rows = max(1, COMPARED // len(rest))
            near = (np.bitwise_count(front[:rows, None] ^ rest[None, :]) <= threshold).any(axis=0)
            out += [(x, int(root)) for x in rest[near].tolist()]
            front, rest = np.concatenate([front[rows:], rest[near]]), rest[~near]
    return out


def _divided(key: int, fps: np.ndarray) -> Iterator[np.ndarray]:
    """The fingerprints of one anchor, in groups that have every two of them that link.

    Where there are many, a group has those of one value of one of the other half's four
    bytes: of 3 bits that differ, at least one byte has none.
    """
    if len(fps) <= DIVIDED:
        yield fps
        return
    for k in range(4):
        byte = fps >> np.uint64(8 * k + (0 if key >> 32 & 1 else 32)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        yield from np.split(fps[order], np.flatnonzero(np.diff(byte[order])) + 1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by anchor; the last anchor of a batch waits for the next."""

    def linked(keys: np.ndarray, fps: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        live = (end - begin > 1) & (np.add.reduceat(homes.astype(np.int64), begin) > 0)
        return [pair for a, b in zip(begin[live].tolist(), end[live].tolist()) for part in _divided(int(keys[a]), fps[a:b]) for pair in links_at(part)]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps, homes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1]))
        if last or held and held[-1][0][-1] != keys[-1]:
            whole = [*held, (keys[:last], fps[:last], homes[:last])]
            if pairs := linked(*(np.concatenate(x) for x in zip(*whole))):
                yield out(pairs)
            held = []
        held.append((keys[last:], fps[last:], homes[last:]))
    if held and (pairs := linked(*(np.concatenate(x) for x in zip(*held)))):
        yield out(pairs)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between different fingerprints that span all links of ``fp``."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            index, keys, homes = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[index].view(np.int64)), pa.array(homes)], names=["anchor", "fp", "home"])

    sent = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    dealt = sent.repartition(shuffle_partitions(distinct.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare, "u long, v long")


def linked_components(prints: DataFrame) -> DataFrame:
    """The table of ``doc_id``, ``fp`` and what else it has, with ``component_id`` and ``root``.

    The component of a document is the smallest id that links reach, its own included;
    null ids count only where there are no others. Its root is one of its fingerprints and
    tells it from all others, also where ids are null or repeat. Equal fingerprints are one
    node, so copies are never compared with each other.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes)).select(F.col("node").alias("fp"), "root")
    named = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id", "root"), "fp").select(*prints.columns, "component_id", "root")


def op10(docs: DataFrame) -> DataFrame:
    """Fingerprints and components of all ``documents``."""
    out = linked_components(checkpointed(fingerprints(docs)))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
