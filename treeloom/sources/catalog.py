"""Which documents there are, and which one a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import strip
from treeloom.operators.shape import build_xml


def available(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Sorted names of the documents, underscores as spaces."""
    return documents.select(F.translate(F.col(doc_id), "_", " ").alias("name")).orderBy("name")


def resolve(requests: DataFrame, documents: DataFrame, name: str = "name", doc_id: str = "doc_id") -> DataFrame:
    """The ``doc_id`` for each requested name, null if there is none.

    An exact match goes before one with underscores for spaces, and both before one that
    differs in case alone. All three share one key, so this is one equi-join; within a
    request the least id of the best kind wins.
    """
    fold = lambda c: F.lower(F.translate(c, "_", " "))
    wanted = requests.select(F.col(name).alias("name"), strip(F.col(name)).alias("wanted"))
    asked = wanted.withColumn("k", fold(F.col("wanted"))).distinct()
    there = documents.select(F.col(doc_id).alias("doc_id"), fold(F.col(doc_id)).alias("k"))
    kind = F.when(F.col("doc_id") == F.col("wanted"), 0).when(F.col("doc_id") == F.translate("wanted", " ", "_"), 1).otherwise(2)
    found = asked.join(there, "k", "left").groupBy("name").agg(F.min_by("doc_id", F.struct(kind, "doc_id")).alias("doc_id"))
    return found


def missing(names: DataFrame, documents: DataFrame, name: str = "name") -> DataFrame:
    """Names without a document: what an idempotent collection has still to fetch.

    A document's id is its name with underscores for spaces."""
    key = lambda c: F.translate(F.col(c), " ", "_").alias("__key")
    return names.select("*", key(name)).join(documents.select(key("doc_id")).distinct(), "__key", "left_anti").drop("__key")


def chosen_template(templates: Column, prefixes: tuple[str, ...] = ("infobox country", "infobox sovereign state")) -> Column:
    """Of an array of structs (template, fields), the fields of the first whose name begins
    with one of the prefixes, without regard to case; null if none does."""
    named = F.filter(templates, lambda t: F.lower(t["template"]).rlike("^(" + "|".join(prefixes) + ")"))
    return F.filter(F.get(named, 0)["fields"], lambda x: x["key"] != "template")


def collected(names: DataFrame, fetched: DataFrame, documents: DataFrame, *, strategy: str = "single_node", aliases: dict[str, str] | None = None) -> DataFrame:
    """New documents for the names that have none yet: ``doc_id``, ``name``, ``xml``, ``error``.

    ``fetched`` has ``name`` and ``templates``, the templates of the page of that name. A
    name without a page, or whose page has no such template, gets a null ``xml`` and an
    error. What is in ``documents`` is not made again, so a run can be repeated.
    """
    wanted = missing(names.select("name").where("name IS NOT NULL").distinct(), documents)
    record = wanted.join(fetched.select("name", chosen_template("templates").alias("fields")).hint("merge"), "name", "left")
    made = build_xml(record.select(F.struct("name", F.col("fields").isNotNull().alias("found")).alias("doc_id"), "name", "fields"), strategy=strategy, aliases=aliases)
    name, found = F.col("doc_id")["name"], F.col("doc_id")["found"]
    return made.select(F.translate(name, " ", "_").alias("doc_id"), name.alias("name"), F.when(found, F.col("xml")).alias("xml"), F.when(~found, F.concat(F.lit("no infobox for "), name)).alias("error"))
