"""Improbable-feature document fingerprints (operator 8).

Every window of 64 bytes has an entropy; windows are ranked by how rarely their entropy
occurs in the whole corpus. A window that is the rarest of at least 16 of the runs of 64
neighbouring windows is a feature. Features go, hashed to 5 bits each, into a chain of
Bloom filters of 2,048 bits, 160 features a filter. Two fingerprints are compared by the
bits that their filters share, normalised between what chance and full overlap give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import shuffle_partitions, string_column

WINDOW = 64
POPULAR = 16
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Entropies are counted in so many steps from 0 to 6 bits.
STEPS = 1000
#: Windows of less entropy (runs of few byte values) are features only for want of others.
LEAST_STEP = 250
#: Bytes of texts that are looked at together.
SLICE = 1 << 18

_SCALE = 1 << 12
#: c * log2(c) in fixed point, so that sums do not depend on their order.
_WEIGHTS = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int64)
_FULL = 6 * WINDOW * _SCALE


def steps(data: np.ndarray) -> np.ndarray:
    """The entropy step (0 to STEPS) of each window of ``data``, by its start.

    From one window to the next a byte leaves and a byte enters; how often each occurs in
    its window is counted for all windows at once by comparing shifted copies.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    change = _WEIGHTS[1:] - _WEIGHTS[:-1]  # change[c - 1]: what the c-th occurrence adds
    first = _WEIGHTS[np.bincount(data[:WINDOW], minlength=256)].sum()
    moves = change[before[WINDOW:] - 1] - change[after[: n - WINDOW] - 1]
    total = np.concatenate([[first], first + np.cumsum(moves)])
    return (_FULL - total) * STEPS // _FULL


def ranks(counts: np.ndarray) -> np.ndarray:
    """The rank of each step: the rarer its windows are, the lower; weak steps come last."""
    order = np.lexsort((np.arange(STEPS + 1), counts, np.arange(STEPS + 1) < LEAST_STEP))
    out = np.empty(STEPS + 1, np.int64)
    out[order] = np.arange(STEPS + 1)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array, short ones filled with zero bytes, with starts and lengths."""
    filled = [x.ljust(WINDOW, b"\0") if x else x for x in texts]
    lengths = np.array([len(x) for x in filled], np.int64)
    return np.frombuffer(b"".join(filled), np.uint8), np.cumsum(lengths) - lengths, lengths


def _sliding_min(keys: np.ndarray) -> np.ndarray:
    """The least of each run of WINDOW keys, by the run's start."""
    span = 1
    while span < WINDOW:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return keys


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's index and the 64-bit hash of each feature, in order of place, once each."""
    data, starts, lengths = _joined(texts)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    owner = np.repeat(np.arange(len(texts)), np.maximum(lengths - WINDOW + 1, 0))
    at = np.arange(len(owner)) + np.repeat(np.where(lengths > 0, WINDOW - 1, 0).cumsum() - np.where(lengths > 0, WINDOW - 1, 0), np.maximum(lengths - WINDOW + 1, 0))
    ranked = rank[steps(data)[at]]
    keys = ranked << 40 | np.arange(len(owner))
    found = np.zeros(0, np.int64)
    if len(keys) >= WINDOW:
        least = _sliding_min(keys)
        inside = owner[: len(least)] == owner[WINDOW - 1 :]
        best = (least & (1 << 40) - 1)[inside]
        if len(best):
            cut = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1, [len(best)]])
            found = best[cut[:-1]][np.diff(cut) >= POPULAR]
            found = found[ranked[found] <= STEPS - LEAST_STEP]
    lacking = np.setdiff1d(np.flatnonzero(lengths > 0), owner[found])
    if len(lacking):
        windows = lengths - WINDOW + 1
        bounds = np.cumsum(np.maximum(windows, 0)) - np.maximum(windows, 0)
        extra = [int(keys[bounds[k] : bounds[k] + windows[k]].min()) & (1 << 40) - 1 for k in lacking]
        found = np.sort(np.concatenate([found, np.array(extra, np.int64)]))
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at[found]]).view("<u8")
    h = np.full(len(found), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    who = owner[found]
    once = np.sort(np.unique(h ^ (who.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)), return_index=True)[1])
    return who[once], h[once]


def filters(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """For each text its chain of filters: an array of (filters, bytes of a filter)."""
    who, h = features(texts, rank)
    number = np.bincount(who, minlength=len(texts))
    chain = -(-number // FILTER_FEATURES)
    base = np.cumsum(chain) - chain
    place = np.arange(len(who)) - (np.cumsum(number) - number)[who]
    row = base[who] + place // FILTER_FEATURES
    bits = np.zeros((int(chain.sum()), FILTER_BITS), np.uint8)
    for k in range(HASHES):
        bits[row, (h >> np.uint64(11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n] for a, n in zip(base.tolist(), chain.tolist())]


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 (what chance shares) to 1: symmetric, and 1 for equal fingerprints.

    Each filter of the shorter chain takes its best score over the other chain; scores are
    weighed by the filter's bits. Of two chains equally long, both directions count. An
    empty fingerprint is like an empty one only.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b) == 1:
        shared = np.bitwise_count(a & b).sum(axis=1, dtype=np.float64)[:, None]
    else:
        shared = np.unpackbits(a, axis=1).astype(np.float32) @ np.unpackbits(b, axis=1).astype(np.float32).T
    own, other = np.bitwise_count(a).sum(axis=1, dtype=np.float64), np.bitwise_count(b).sum(axis=1, dtype=np.float64)
    chance = own[:, None] * other[None, :] / FILTER_BITS
    score = np.clip((shared - chance) / np.maximum(np.minimum(own[:, None], other[None, :]) - chance, 1e-9), 0.0, 1.0)
    one = float((score.max(axis=1) * own).sum() / own.sum())
    if len(a) != len(b):
        return one
    return (one + float((score.max(axis=0) * other).sum() / other.sum())) / 2


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def rarity(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The ranks of entropy steps over all windows of all texts; a count for each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            for texts in _slices(map(_bytes, string_column(batch, "text"))):
                data, starts, lengths = _joined(texts)
                if len(data):
                    mine = np.ones(len(data) - WINDOW + 1, bool)
                    for s in starts[1:][lengths[1:] > 0].tolist():  # windows across two texts
                        mine[max(0, s - WINDOW + 1) : s] = False
                    counts += np.bincount(steps(data)[mine], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(counts)], names=["step", "n"])

    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    counts = np.zeros(STEPS + 1, np.int64)
    for row in found.collect():  # one row for each step at most
        counts[row["step"]] = row["n"]
    return ranks(counts)


def _slices(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x)
        if n >= SLICE:
            yield held
            held, n = [], 0
    if held:
        yield held


def fingerprints(df: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row's whole text (null: empty)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded(chain) for texts in _slices(map(_bytes, string_column(batch, "text"))) for chain in filters(texts, rank)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, rows.select("doc_id", F.col("text").alias("fingerprint")).schema)


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half, rounded down, replaced by as much of what follows."""
    text = text or ""
    half = len(text) // 2
    return text[: len(text) - half] + (following or "")[:half]


def with_following(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt and sorted so that each is followed by the next in order of id.

    Ids are cut into ranges by approximate quantiles. A range ends with the first row of
    the next one (of the first one, after the last), marked ``extra``, so each can be
    streamed on its own and every text is moved once. Null ids come first; rows of equal
    ids follow by text.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), key, F.col(text_col).cast("string").alias("text"))
    parts = shuffle_partitions(df.sparkSession)
    number = 4 * parts
    quantiles = rows.stat.approxQuantile("key", [k / number for k in range(1, number)], 0.25 / number) if number > 1 else []
    cuts = np.unique(np.array(quantiles, np.float64))

    @F.pandas_udf("int")
    def cut(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.float64), side="right").astype(np.int32))

    placed = rows.withColumn("cut", cut("key"))
    firsts = sorted((r["cut"], r["key"]) for r in placed.groupBy("cut").agg(F.min("key").alias("key")).collect())
    heads = [(k, firsts[at - 1][0]) for at, (_, k) in enumerate(firsts)] or [(0, 0)]
    # One row for each range, so the table is as bounded as the number of partitions.
    heads = F.broadcast(df.sparkSession.createDataFrame(heads, "key long, previous int"))
    own, more = F.struct(F.col("cut").alias("cut"), F.lit(False).alias("extra")), F.struct(F.col("previous").alias("cut"), F.lit(True).alias("extra"))
    sent = placed.join(heads, "key", "left").select("doc_id", "key", "text", F.explode(F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("to"))
    sent = sent.select("to.cut", "to.extra", "doc_id", "key", "text")
    return sent.repartition(parts, "cut").sortWithinPartitions("cut", "extra", "key", "text").select("cut", "extra", "doc_id", "text")


def op8(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts, with likenesses."""
    rank = rarity(docs)

    def finish(rows: list[tuple[int, str | None]], following: str | None) -> pa.RecordBatch:
        texts = [x for _, x in rows] + [following]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, new = filters([*map(_bytes, texts)], rank), filters([*map(_bytes, changed)], rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(x or "") for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(_bytes(x)).hexdigest() for x in changed], pa.string()),
                pa.array([*map(encoded, own[:-1])], pa.string()),
                pa.array([*map(encoded, new)], pa.string()),
                pa.array([*map(likeness, own, new)], pa.float64()),
                pa.array([*map(likeness, own, own[1:])], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str | None]] = []
        size = 0
        for batch in batches:
            for extra, i, text in zip(*(string_column(batch, x) for x in ("extra", "doc_id", "text"))):
                if held and (extra or size >= SLICE):
                    yield finish(held, text)
                    held, size = [], 0
                if not extra:
                    held.append((i, text))
                    size += len(text or "")

    return with_following(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
