"""Language identification by compression (operator 4).

Each language is a raw-content zstandard dictionary cut from labelled texts. A text is
encoded with every dictionary and belongs to the language whose encoding is smallest. A
prediction is rejected when the best and the second-best sizes are too near each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import string_column

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
LEVEL = 6

#: The fitting sample: the training texts of a language are dealt over this many buckets by
#: a hash of the text; the text of least hash in each bucket is used.
SAMPLE_BUCKETS = 256
#: Bytes of one language's dictionary; texts are taken in hash order, so many bytes of each
#: at most.
DICTIONARY_BYTES = 49152
BYTES_OF_TEXT = 1024


def normalised(text: str) -> bytes:
    """The distinct words of a whole text in order of first appearance, in lower case.

    Digits, punctuation and repetitions tell nothing about a language, but would drown
    what does in the sizes.
    """
    return " ".join(dict.fromkeys(NOT_LETTERS.sub(" ", text.lower()).split())).encode()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _parameters() -> zstd.ZstdCompressionParameters:
    return zstd.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)


class Classifier:
    """Encoders by language, in code-point order of the languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.encoders = []
        for language in self.languages:
            content = zstd.ZstdCompressionDict(dictionaries[language], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=_parameters())
            self.encoders.append(zstd.ZstdCompressor(dict_data=content, compression_params=_parameters()))

    def sizes(self, text: str) -> list[int]:
        data = normalised(text)
        return [len(x.compress(data)) for x in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin to the next (0 to 1); ``und`` and 0 without letters."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        order = sorted(zip(self.sizes(text), range(len(self.languages))))
        if len(order) == 1:
            return self.languages[0], 1.0
        (best, k), (second, _) = order[:2]
        return self.languages[k], (second - best) / second


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, buckets: int = SAMPLE_BUCKETS, dictionary_bytes: int = DICTIONARY_BYTES, bytes_of_text: int = BYTES_OF_TEXT) -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows.

    The sample is bounded by ``buckets`` texts a language, and the result by
    ``dictionary_bytes`` a language. Rows without text or language are not used; an empty
    table gives no dictionaries. It depends on texts and languages alone, so order,
    repeated rows and partitions do not change it.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND lang <> ''").withColumn("h", F.xxhash64("text"))
    least = rows.groupBy("lang", F.pmod("h", F.lit(buckets)).alias("b")).agg(F.min("h").alias("h")).drop("b")
    # The sample has `buckets` rows a language at most, so its key set is bounded.
    sample = rows.join(F.broadcast(least), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.select("lang", "h", F.substring("text", 1, 4 * bytes_of_text).alias("text")).toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["h"], row["text"]))
    out = {}
    for language, sampled in texts.items():
        data = b" ".join(normalised(text)[:bytes_of_text] for _, text in sorted(sampled))
        if data.strip():
            out[language] = data[:dictionary_bytes]
    return out


def identify(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", *keep: str, min_margin: float = 0.004) -> DataFrame:
    """``lang_pred``, ``score`` (the margin) and ``rejected`` for each row's whole text.

    A text that is null, empty or without a letter is ``und`` with score 0 and rejected, as
    is every text when there are no dictionaries. Equal sizes go to the language first in
    code-point order, with score 0. Rows come out as often as they went in. Columns to
    keep are returned in a struct ``kept``; others are not read.
    """

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(x) for x in string_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(2, batch.num_columns)), batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64()), pa.array([x == UNDETERMINED or m < min_margin for x, m in found], pa.bool_())],
                names=[*["kept"] * bool(keep), "doc_id", "lang_pred", "score", "rejected"],
            )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    schema = T.StructType([*rows.schema.fields[2:], T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(classify, schema)


def held_out(id_col: str = "doc_id"):
    """Whether the CRC-32 of the id's decimal text is a multiple of 5; false for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained_on(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that may be learnt from: those whose id has a non-zero remainder."""
    return df.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0)


def op4(docs: DataFrame) -> DataFrame:
    """Predictions for all ``documents``, learnt from those that are not held out."""
    found = identify(docs, fit(trained_on(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
