"""Questions about documents and pairs of them, each answered as a DataFrame.

``Library`` holds the tree table of a corpus; its methods only build plans. Names are
resolved as in :func:`treeloom.sources.catalog.resolve`, before any tree is looked into; a
name without a document gives a row with ``error``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.model import ALGORITHMS
from treeloom.operators import nodes as N
from treeloom.operators.distance import distances, similarity, with_trees
from treeloom.operators.script import edit_ops, op_counts, with_ops
from treeloom.operators.semantic import categorised, category, change_summary
from treeloom.plans.render import report
from treeloom.plans.run import run
from treeloom.sources.catalog import available, collected, resolve
from treeloom.sources.config import CostModel


class Library:
    """``fetched`` (``name``, ``templates``) is what :meth:`collect` may make documents of;
    ``output`` is the folder that :meth:`run_all` writes to."""

    def __init__(self, trees: DataFrame, costs: CostModel | dict | None = None, aliases: dict[str, str] | None = None, *, fetched: DataFrame | None = None, output: str | None = None):
        self.plain = trees
        self.trees = N.normalise(trees, aliases or {})
        self.costs = CostModel.of(costs)
        self.aliases, self.fetched, self.output = aliases or {}, fetched, output

    @property
    def spark(self) -> SparkSession:
        return self.trees.sparkSession

    def _asked(self, *names: str) -> DataFrame:
        return resolve(self.spark.createDataFrame([(x,) for x in names], "name string"), self.plain.select("doc_id"))

    def _of(self, name: str) -> DataFrame:
        """One row: ``name``, and the document's ``doc_id``, ``n`` and ``nodes`` or nulls."""
        return self._asked(name).join(self.trees.hint("merge"), "doc_id", "left")

    def _ids(self, first: str, second: str) -> DataFrame:
        a = self._asked(first).select(F.lit(1).alias("k"), F.coalesce("doc_id", "name").alias("src"))
        b = self._asked(second).select(F.lit(1).alias("k"), F.coalesce("doc_id", "name").alias("dst"))
        return a.join(b, "k").drop("k")

    def _pair(self, first: str, second: str) -> DataFrame:
        """One pair with its trees; a document that isn't there has null nodes."""
        lacks = lambda s: F.concat(F.lit("no data for "), s)
        return with_trees(self._ids(first, second), self.trees).withColumn("error", F.when(F.col("src_nodes").isNull(), lacks("src")).when(F.col("dst_nodes").isNull(), lacks("dst")))

    def _scripts(self, first: str, second: str, algorithm: str) -> DataFrame:
        return with_ops(distances(self._pair(first, second).where("error IS NULL").drop("error"), self.costs, algorithm), self.costs)

    def list_documents(self) -> DataFrame:
        return available(self.plain)

    def document_info(self, name: str) -> DataFrame:
        """A row for each field: ``node_count``, ``field_count``, ``field``, ``text``. Of
        fields of one name the last counts."""
        found = self._of(name)
        fields = N.fields(found).where("node_type = 'element'")
        last = fields.groupBy("doc_id", F.col("label").alias("field")).agg(F.max_by("text", "child_pos").alias("text"), F.min("child_pos").alias("pos"))
        named = F.size(F.array_distinct(F.transform(F.filter("nodes", lambda x: (x["depth"] == 1) & (x["node_type"] == "element")), lambda x: x["label"])))
        head = found.select("name", "doc_id", F.col("n").alias("node_count"), F.when(F.col("n").isNotNull(), named).otherwise(0).cast("long").alias("field_count"))
        return head.join(last, "doc_id", "left").select("name", "node_count", "field_count", "pos", "field", "text", F.when(F.col("node_count").isNull(), F.concat(F.lit("no data for "), "name")).alias("error"))

    def compare(self, first: str, second: str, algorithm: str = "chawathe") -> DataFrame:
        """The pair's distance, metrics and operations, all null where a document is missing."""
        made = similarity(with_ops(distances(self._pair(first, second), self.costs, algorithm), self.costs))
        shown: dict[str, Column] = {"algorithm": F.col("algorithm"), "t1_nodes": F.size("src_nodes"), "t2_nodes": F.size("dst_nodes"), "ted": F.col("ted"), "raw_ted": F.col("raw_ted"), "sim_inverse": F.col("sim_inverse"), "sim_ratio": F.col("sim_ratio")} | op_counts()
        return made.select("src", "dst", "error", *(F.when(F.col("error").isNull(), c).alias(k) for k, c in shown.items()))

    def script_details(self, first: str, second: str, algorithm: str = "chawathe", shown: int = 30) -> DataFrame:
        """The first operations in script order (``index`` from 0), with how many there are
        in all and in their category."""
        scripts = self._scripts(first, second, algorithm).withColumn("cats", F.transform("ops", lambda x: category(x["field"])))
        rows = scripts.select("src", "dst", "ted", "cats", F.posexplode(F.slice("ops", 1, shown)).alias("index", "x"), F.size("ops").cast("long").alias("total_operations"))
        mine = category(F.col("x.field"))
        return rows.select("src", "dst", "ted", F.col("index").cast("long").alias("index"), F.col("x.op_type").alias("op"), "x.field", mine.alias("category"), F.col("x.label").alias("node_label"), "x.node_type", "x.cost", F.when(F.col("x.op_type") == "relabel", F.col("x.label")).alias("from"), F.col("x.new_label").alias("to"), F.size(F.filter("cats", lambda c: c == mine)).cast("long").alias("category_total"), "total_operations", (F.col("total_operations") > shown).alias("truncated"))

    def collect(self, name: str) -> DataFrame:
        """The document of a name that has none yet, made of the fetched pages; no row if
        there is one. ``success`` says whether one was made."""
        if self.fetched is None:
            raise ValueError("the library has no fetched pages")
        made = collected(self.spark.createDataFrame([(name,)], "name string"), self.fetched, self.plain, aliases=self.aliases)
        return made.select("name", F.col("xml").isNotNull().alias("success"), "doc_id", "xml", "error")

    def field_value(self, name: str, field: str) -> DataFrame:
        """The first field of that name, without regard to case; else the names that contain
        it; else all names of element fields."""
        found = self._of(name)
        wanted = F.lower(F.lit(field))
        order = lambda cond, c: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("child_pos", F.col(c).alias("x"))))), lambda p: p["x"])
        exact = F.lower("label") == wanted
        hit = F.min(F.when(exact, F.struct("child_pos", "label", "text", "node_type", "child_count")))
        seen = N.fields(found).groupBy("doc_id").agg(hit.alias("hit"), order(F.lower("label").contains(wanted), "label").alias("similar"), order(F.col("node_type") == "element", "label").alias("all"))
        none = F.col("hit").isNull()
        return found.select("name", "doc_id").join(seen, "doc_id", "left").select(
            "name", F.coalesce("hit.label", F.lit(field)).alias("field"), F.col("hit.text").alias("value"), F.col("hit.node_type").alias("node_type"), F.col("hit.child_count").alias("child_count"),
            F.when(none & (F.size("similar") > 0), F.col("similar")).alias("similar_fields"), F.when(none & (F.size("similar") == 0), F.col("all")).alias("available_fields"),
            F.when(F.col("doc_id").isNull(), "no data").when(none, "field not found").alias("error"),
        )

    def compare_fields(self, first: str, second: str, fields: list[str]) -> DataFrame:
        """For each asked field both texts (``(not present)`` if there is none) and whether
        they are the same; null unless both are there."""
        asked = self.spark.createDataFrame(list(enumerate(fields)), "pos int, field string")

        def side(name: str, c: str) -> DataFrame:
            values = N.fields(self._of(name)).groupBy(F.lower("label").alias("k")).agg(F.min_by("text", "child_pos").alias("text"))
            return values.select("k", F.when(F.col("text") != "", F.col("text")).alias(c))

        both = asked.withColumn("k", F.lower("field")).join(side(first, "a"), "k", "left").join(side(second, "b"), "k", "left")
        shown = lambda c: F.coalesce(c, F.lit("(not present)"))
        return both.select("pos", "field", shown("a").alias("value1"), shown("b").alias("value2"), (F.col("a") == F.col("b")).alias("same"))

    def semantic_similarity(self, first: str, second: str, algorithm: str = "chawathe") -> DataFrame:
        """A row for each category of changes, with the structural metrics of the pair."""
        scripts = similarity(self._scripts(first, second, algorithm))
        metrics = scripts.select("src", "dst", "raw_ted", "sim_inverse", "sim_ratio")
        return change_summary(scripts).join(metrics, ["src", "dst"])

    def report(self, first: str, second: str) -> DataFrame:
        """``src``, ``dst`` and the comparison as Markdown."""
        return report(self._scripts(first, second, "chawathe"))

    def operations(self, first: str, second: str, algorithm: str = "chawathe") -> DataFrame:
        return edit_ops(self._scripts(first, second, algorithm))

    def categories(self, first: str, second: str, algorithm: str = "chawathe") -> DataFrame:
        return categorised(self._scripts(first, second, algorithm))

    def run_all(self, first: str, second: str) -> DataFrame:
        """Everything that :func:`treeloom.plans.run.run` writes for the pair, below the
        library's output folder; the summary row."""
        if self.output is None:
            raise ValueError("the library has no output folder")
        return run(self.trees.join(self._asked(first, second).select("doc_id"), "doc_id", "left_semi"), self._ids(first, second), self.output, self.costs)


_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_ALGORITHM = {"type": "string", "enum": list(ALGORITHMS)}
_ONE = {"country": _TEXT}
_PAIR = {"country1": _TEXT, "country2": _TEXT}
#: What :func:`dispatch` may call: method, arguments in order, what it answers. Arguments
#: with choices may be left out.
TOOLS = {
    "list_available_countries": ("list_documents", {}, "The names of all documents."),
    "get_country_info": ("document_info", _ONE, "Fields, texts and size of a document."),
    "compare_countries": ("compare", _PAIR | {"algorithm": _ALGORITHM}, "Distance, similarity and numbers of operations of a pair."),
    "get_edit_script_details": ("script_details", _PAIR | {"algorithm": _ALGORITHM}, "The first thirty operations that turn one document into the other."),
    "collect_country": ("collect", _ONE, "Makes the document of a fetched page that has none yet."),
    "get_field_value": ("field_value", _ONE | {"field": _TEXT}, "One field of a document, or what fields there are."),
    "compare_specific_fields": ("compare_fields", _PAIR | {"fields": _TEXTS}, "Some fields of both documents side by side."),
    "compute_semantic_similarity": ("semantic_similarity", _PAIR | {"algorithm": _ALGORITHM}, "Changes of a pair by category, with its metrics."),
    "generate_comparison_report": ("report", _PAIR, "A pair's comparison as Markdown."),
    "run_full_pipeline": ("run_all", _PAIR, "Writes everything about a pair and returns its summary."),
}


def schemas() -> list[dict]:
    """The tools as function schemas: names, what they answer, types of arguments."""
    return [
        {"type": "function", "function": {"name": name, "description": says, "parameters": {"type": "object", "properties": arguments, "required": [k for k, kind in arguments.items() if "enum" not in kind]}}}
        for name, (_, arguments, says) in TOOLS.items()
    ]


def dispatch(library: Library, tool: str, arguments: dict) -> str:
    """A tool by name with its arguments by name; the rows, or what went wrong, as JSON.

    The answers are about one document or pair, so their rows are few.
    """
    if tool not in TOOLS:
        return json.dumps({"error": f"unknown tool: {tool}"})
    method, known, _ = TOOLS[tool]
    try:
        if unknown := set(arguments) - set(known):
            raise TypeError(f"unknown arguments: {', '.join(sorted(unknown))}")
        rows = getattr(library, method)(*(arguments[k] for k in known if k in arguments)).toJSON().collect()
        return json.dumps({"rows": [json.loads(x) for x in rows]}, ensure_ascii=False)
    except Exception as e:
        return json.dumps({"error": f"{type(e).__name__}: {e}"})
