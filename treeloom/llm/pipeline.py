"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All
but the last return the columns of ``documents``, whichever those are; the last returns the
pieces of documents with their places in packed sequences. An empty table stays empty in
every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import checkpointed, table
from treeloom.llm.language_id import fit, identify, trained_on
from treeloom.llm.line_dedup import dedup_lines, has_word
from treeloom.llm.mixing import mix
from treeloom.llm.packing import pack_documents, words
from treeloom.llm.shingle_sets import roots
from treeloom.llm.simhash import fingerprints, linked_components


def _whole(docs: DataFrame) -> Column:
    """What tells a row from others: its id and 128 bits of a hash of all columns.

    A hash skips nulls, so which columns are null is hashed as well.
    """
    every = [*docs.columns, *(F.col(c).isNull() for c in docs.columns)]
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(1), *every).alias("b"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; a missing ``lang`` becomes that language.

    What is rejected (null texts, texts without a letter, two languages too near each other)
    goes. Ids do not matter: null, repeated and equal rows are each judged alone.
    """
    found = identify(docs, fit(trained_on(docs)), "doc_id", "text", *docs.columns).where("NOT rejected")
    return found.select(*(F.coalesce("kept.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"kept.{c}").alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one.

    ``n_chars`` becomes that of what is left. A document whose every worded line went goes;
    one that had none (a null or empty text) stays. Null ids come first in the order of
    documents; see ``dedup_lines`` for ids that repeat.
    """
    out = dedup_lines(docs, "doc_id", "text", *(c for c in docs.columns if c != "text"))
    left = out.where((F.col("n_removed") == 0) | has_word(F.col("text")))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("kept.n_chars")).otherwise(F.char_length("text")).cast("long")}
    return left.select(*(changed[c].alias(c) if c in changed else F.col(f"kept.{c}").alias(c) for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, null ids last.

    Near copies are linked by fingerprints of 3 differing bits at most, or by sets of
    five-word shingles whose Jaccard similarity is 0.8 at least. Of a group's different rows
    with that id, the one whose hash is least stays; of equal ones, one. Rows in different
    groups do not matter to each other, whatever their ids, so unrelated rows of null or
    equal ids all stay. Null and empty texts are one group.
    """
    rows = docs.select(*docs.columns, _whole(docs).alias("__row"), F.xxhash64("text").alias("__text"))
    prints = checkpointed(linked_components(checkpointed(fingerprints(rows, "doc_id", "text", "__row", "__text"))).select("doc_id", "__row", "__text", "root"))
    least = prints.groupBy("root").agg(F.min("__text").alias("v"))
    linked = checkpointed(prints.join(least, "root").where("__text <> v").select(F.col("__text").alias("u"), "v").distinct())
    found = roots(rows.select(F.col("__text").alias("node"), "text"), linked, prints.count())
    if found is not None:
        prints = prints.join(found.select(F.col("node").alias("__text"), F.col("root").alias("__joined")), "__text", "left").withColumn("root", F.coalesce("__joined", "__text"))
    least = prints.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("__row"))
    return _once(docs, prints.select("__row")).join(least.select("__row"), "__row", "left_semi").drop("__row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all.

    Equal rows are entries of their own in the mix. Texts without a word take nothing from
    it and go. A null source is a source.
    """
    sized = checkpointed(docs.select(_whole(docs).alias("__row"), "source", words().alias("size")))
    taken = mix(sized, "__row").groupBy(F.col("doc_id").alias("__row")).agg(F.count(F.lit(1)).cast("int").alias("__times"))
    out = _once(docs, sized.select("__row")).join(taken, "__row")
    return out.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def _once(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, equal rows once; texts are dealt for it only where some are equal."""
    repeats = not rows.groupBy("__row").count().where("count > 1").isEmpty()
    return (docs.dropDuplicates() if repeats else docs).withColumn("__row", _whole(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each as often as the mix has it, packed by their number of words."""
    return pack_documents(checkpointed(docs.select("doc_id", words().alias("n_tokens"))))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Compression sizes, hash bits and best-fit packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result cut from what it came of."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
