"""Token counts by a count-only Viterbi search (operator 2).

An Aho-Corasick automaton of a unigram vocabulary enumerates every piece that ends at each
character of a word; dynamic programming keeps, for each end, the best score and its
number of pieces. No pieces or paths are kept.

The rules are those of unigram tokenizers: white space is marked by ``▁`` and words are
segmented one by one; among equal scores the longest last piece wins; a character with no
piece of its own may be unknown, at the lowest score less 10, and then counts as its
UTF-8 bytes where the vocabulary has byte pieces, else a run of them counts as one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import string_column

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; beyond it begins anew.
CACHED_WORDS = 300_000


class Vocabulary(NamedTuple):
    pieces: dict[str, float]
    byte_fallback: bool


def load_vocabulary(model_file: str = DEFAULT_MODEL) -> Vocabulary:
    """The ordinary pieces of a SentencePiece model as a unigram vocabulary.

    A unigram model's own scores are used. A merge model has ranks in place of scores: its
    piece of rank r gets the logarithm of r's share under Zipf's law.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    ordinary = [i for i in ids if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
    if all(x <= 0 and x == int(x) for x in scores.values()):
        scores = {k: max(x, -float(len(scores))) for k, x in scores.items()}  # those without a rank come last
        total = math.log(sum(1 / (1 - x) for x in scores.values()))
        scores = {k: -math.log(1 - x) - total for k, x in scores.items()}
    return Vocabulary(scores, any(model.is_byte(i) for i in ids))


class PieceCounter:
    """Counts pieces of words and texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.found = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            self.found.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.found.make_automaton()
        self.matches = self.found.iter if vocabulary.pieces else lambda word: ()
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = vocabulary.byte_fallback
        # A text is cut where no piece can reach across: before each mark, or, with pieces
        # that have several marks at their start, before each run of marks.
        inner = [x for x in vocabulary.pieces if MARK in x[1:]]
        self.cut = f"{MARK}[^{MARK}]*" if not inner else f"{MARK}+[^{MARK}]*" if not any(MARK in x.lstrip(MARK) for x in inner) else "(?s).+"
        self.cache: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of one marked word."""
        n = len(word)
        best, count, run = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends up to here have got their unknown candidate

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    score = best[done - 1] + self.unknown
                    if score > best[done]:
                        more = len(word[done - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else not run[done - 1]
                        best[done], count[done], run[done] = score, count[done - 1] + more, True

        single = [False] * (n + 1)
        for last, (length, score) in self.matches(word):  # by end, the longest first
            end = last + 1
            if end - 1 > done:
                close(end - 1)
            if length == 1:
                single[end] = True
            score += best[end - length]
            if score > best[end]:
                best[end], count[end], run[end] = score, count[end - length] + 1, False
        close(n)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text; 0 and 0.0 for null and empty ones."""
        if not text:
            return 0, 0.0
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        number, total = 0, 0.0
        marked = MARK + text.replace(MARK, " ").removeprefix(" ").replace(" ", MARK)
        for word, times in Counter(re.findall(self.cut, marked)).items():
            found = cache.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= 64:
                    cache[word] = found
            number += times * found[0]
            total += times * found[1]
        return number, total


def count_tokens(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_chars``, ``n_tokens`` and ``score`` of each row's whole text (null: empty).

    A row comes out for each row that goes in; an empty text has 0 tokens and score 0;
    other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(Vocabulary(*shared.value))
        for batch in batches:
            texts = string_column(batch, "text")
            found = [counter.text(x) for x in texts]
            columns = [pa.array([len(x or "") for x in texts], pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_chars", "n_tokens", "score"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]))


def op2(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """Token counts of all ``documents``."""
    return count_tokens(docs, load_vocabulary(model_file))
