"""Licence scans by winnowed fingerprints and banded alignment (operator 7).

The templates' words make k-grams; of each window of neighbouring k-grams the least hash
is a fingerprint, and an inverted index maps it to its places in templates. A document's
fingerprints are winnowed alike, so any run of w + k - 1 words shared with a template
meets the index. Hits near one diagonal of a template make a candidate, which is aligned
word by word within a band around it; coverage and span are reported. Words weigh by how
few templates have them, so the word that names a licence counts for more than the rest of
its notice. Of matches that overlap, the one of the best alignment stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import string_column
from treeloom.llm.license_texts import TEMPLATES

WORDS = re.compile(r"\w+")
GRAM = 3
WINNOW = 3
#: Part of a template's fingerprints that must be hit near one diagonal.
LEAST_HITS = 0.2
MATCH, OTHER = 2, -1


class Match(NamedTuple):
    license: str
    coverage: float
    start: int
    end: int
    matched: int


class Aligned(NamedTuple):
    """An alignment: its score, its words' span in the text, matched words and their weight,
    and its words' span in the template."""

    score: int
    first: int
    matched: int
    weight: float
    begin: int
    last: int
    until: int


def _mixed(a: int, b: int, c: int) -> int:
    """A fixed hash of three word numbers, so that winnowing does not favour early words."""
    h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9 + 1) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF


def winnowed(numbers: list[int]) -> list[tuple[int, int]]:
    """The hash and place of the fingerprints of a run of words, given by their numbers.

    Of equal least hashes in a window the last counts. A run of fewer k-grams than a
    window is one window; a run shorter than a k-gram has none.
    """
    grams = [_mixed(*numbers[i : i + GRAM]) for i in range(len(numbers) - GRAM + 1)]
    out: dict[int, int] = {}
    for i in range(max(1, len(grams) - WINNOW + 1)) if grams else ():
        j = min(range(i, min(i + WINNOW, len(grams))), key=lambda j: (grams[j], -j))
        out[j] = grams[j]
    return [(h, j) for j, h in out.items()]


class Scanner:
    """The inverted index of some templates; its size is that of the templates."""

    def __init__(self, templates: dict[str, str], min_coverage: float = 0.75):
        self.names = list(templates)
        self.min_coverage = min_coverage
        self.numbers: dict[str, int] = {}
        self.words: list[list[int]] = []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.prints: list[int] = []
        for t, text in enumerate(templates.values()):
            self.words.append([self.numbers.setdefault(w, len(self.numbers)) for w in WORDS.findall(text.lower())])
            found = winnowed(self.words[-1])
            self.prints.append(len(found))
            for h, j in found:
                self.index[h].append((t, j))
        often: dict[int, int] = defaultdict(int)
        for words in self.words:
            for w in set(words):
                often[w] += 1
        self.weights = [[log(1 + len(templates) / often[w]) ** 2 for w in words] for words in self.words]

    def band(self, t: int) -> int:
        return max(4, len(self.words[t]) // 5)

    def candidates(self, numbers: list[int]) -> list[tuple[int, int, int]]:
        """Templates with the least and greatest diagonal of a group of hits."""
        hits: dict[int, list[int]] = defaultdict(list)
        begin = None
        for i, n in enumerate([*numbers, -1]):  # words of no template split the runs
            if n >= 0:
                begin = i if begin is None else begin
            elif begin is not None:
                if i - begin >= GRAM:
                    for h, j in winnowed(numbers[begin:i]):
                        for t, place in self.index.get(h, ()):
                            hits[t].append(begin + j - place)
                begin = None
        out = []
        for t, diagonals in hits.items():
            diagonals.sort()
            first = 0
            for k in range(1, len(diagonals) + 1):
                if k == len(diagonals) or diagonals[k] - diagonals[k - 1] > self.band(t):
                    if k - first >= LEAST_HITS * self.prints[t]:
                        out.append((t, diagonals[first], diagonals[k - 1]))
                    first = k
        return out

    def aligned(self, t: int, numbers: list[int], low: int, high: int) -> Aligned | None:
        """The best local alignment of a template whose diagonals lie between ``low`` and
        ``high``; the earliest among equals."""
        words, weights, best, end = self.words[t], self.weights[t], 0, None
        width, number = high - low + 1, len(numbers)
        nothing = (0, -1, 0, 0.0, -1)
        before = [nothing] * (width + 1)  # score, first place, matched words, their weight, first of the template
        for i, w in enumerate(words):
            row: list[tuple[int, int, int, float, int]] = []
            left = nothing
            for d in range(width):
                j = i + low + d
                cell = nothing
                if 0 <= j < number:
                    score, first, matched, weight, begin = before[d]
                    if numbers[j] == w:
                        cell = (score + MATCH, j if first < 0 else first, matched + 1, weight + weights[i], i if first < 0 else begin)
                    else:
                        cell = (score + OTHER, first, matched, weight, begin)
                    if before[d + 1][0] + OTHER > cell[0]:
                        cell = (before[d + 1][0] + OTHER, *before[d + 1][1:])
                    if left[0] + OTHER > cell[0]:
                        cell = (left[0] + OTHER, *left[1:])
                    if cell[0] <= 0:
                        cell = nothing
                    elif cell[0] > best:
                        best, end = cell[0], Aligned(*cell[:4], cell[4], j, i)
                row.append(cell)
                left = cell
            before = [*row, nothing]
        return end

    def chained(self, t: int, parts: list[Aligned]) -> Iterator[Aligned]:
        """Alignments of one template, those too short joined with the next one if it goes on
        in both template and text, with no more words between than the template has: what
        was put between two clauses does not hide them."""
        enough, held = self.min_coverage * sum(self.weights[t]), None
        for part in sorted(set(parts), key=lambda x: x.first):
            if held and held.until < part.begin and held.last < part.first <= held.last + len(self.words[t]):
                between = part.first - held.last - 1 + part.begin - held.until - 1
                joined = Aligned(held.score + part.score + OTHER * between, held.first, held.matched + part.matched, held.weight + part.weight, held.begin, part.last, part.until)
                part = joined if part.weight < enough else part
            if part.weight >= enough:
                yield part
            held = None if part.weight >= enough else part

    def scan(self, text: str | None) -> list[Match]:
        """Matches of a whole text by place; of those that overlap, the one of the best
        alignment, which need not be of the same template."""
        if not text:
            return []
        get = self.numbers.get
        numbers = [get(w, -1) for w in WORDS.findall(text.lower())]
        parts: dict[int, list[Aligned]] = defaultdict(list)
        for t, low, high in self.candidates(numbers):
            middle, band = (low + high) // 2, self.band(t)
            if hit := self.aligned(t, numbers, min(low, middle - band), max(high, middle + band)):
                parts[t].append(hit)
        found = [(-x.score, -x.weight / sum(self.weights[t]), x.first, x.last, t, x.matched) for t, hits in parts.items() for x in self.chained(t, hits)]
        if not found:
            return []
        # Those kept do not overlap, so each new one has to be compared with two neighbours.
        kept: list[tuple] = []
        for _, coverage, first, last, t, matched in sorted(found):
            k = bisect_left(kept, (first,))
            if (not k or kept[k - 1][1] < first) and (k == len(kept) or last < kept[k][0]):
                kept.insert(k, (first, last, t, -coverage, matched))
        spans = [m.span() for m in WORDS.finditer(text)]
        if len(spans) != len(numbers):  # a capital whose small form is not one word
            spans = [m.span() for m in WORDS.finditer(text.lower())]
        return [Match(self.names[t], round(c, 6), spans[a][0], spans[b][1], n) for a, b, t, c, n in kept]


_MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.IntegerType())]))


def scan(df: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", *, min_coverage: float = 0.75) -> DataFrame:
    """``doc_id`` and ``matches``: template, coverage, span in characters, matched words.

    A match covers ``min_coverage`` of the template's words or more, by weight; matches do
    not overlap. Null and empty texts and empty templates have none. A row comes out for
    each row that goes in; ids may be null or repeat, and other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32())]))
        for batch in batches:
            found = [[m._asdict() for m in scanner.scan(x)] for x in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("matches", _MATCHES)]))


def op7(docs: DataFrame) -> DataFrame:
    """Licences found in all ``documents``: their number, names, best coverage and spans."""
    out = scan(docs, TEMPLATES)
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"], F.round(m["coverage"], 4)))
    return out.select("doc_id", F.size("matches").alias("n_matches"), F.array_join("matches.license", ";").alias("licenses"), F.coalesce(F.array_max("matches.coverage"), F.lit(0.0)).alias("coverage"), F.array_join(spans, ";").alias("spans"))
