"""The whole comparison of pairs, with all that it writes; also a command line.

    python -m treeloom.plans.run run DOCUMENTS SOURCE TARGET OUTPUT [--algorithm A] [--costs FILE] [--strategy S]
    python -m treeloom.plans.run diff DOCUMENTS SOURCE TARGET OUTPUT [...]
    python -m treeloom.plans.run patch DOCUMENTS SOURCE TARGET OUTPUT [--direction forward|reverse] [...]
    python -m treeloom.plans.run postprocess DOCUMENTS NAME OUTPUT [--strategy S]
    python -m treeloom.plans.run collect DOCUMENTS PAGES NAMES OUTPUT [--strategy S] [--aliases FILE]

Documents are XML files, one a document. ``collect`` reads its pages (``name``,
``templates``) and names (``name``) from Parquet tables.
"""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.model import ALGORITHMS, STRATEGIES
from treeloom.operators.distance import distances, similarity, with_trees
from treeloom.operators.patch import apply, residual
from treeloom.operators.script import op_counts, script_text, with_ops
from treeloom.plans import render
from treeloom.sources.catalog import collected
from treeloom.sources.config import CostModel, load_aliases, load_costs
from treeloom.sources.xml import parse_trees, read_documents


def backwards(pairs: DataFrame) -> DataFrame:
    """Pairs with trees, turned around in their own rows."""
    swapped = {"src": "dst", "dst": "src", "src_nodes": "dst_nodes", "dst_nodes": "src_nodes"}
    return pairs.select(*(F.col(swapped.get(c, c)).alias(c) for c in pairs.columns))


def summary_rows(pairs: DataFrame, costs: CostModel | dict | None = None, algorithm: str = "chawathe", at: datetime | None = None) -> DataFrame:
    """A row for each pair with trees: distances, ratios, operations and whether patches are
    perfect, for both directions, with the time of the run. Nothing is joined again, so
    repeated pairs and null ids stay apart."""
    model = CostModel.of(costs)

    def side(rows: DataFrame, s: str) -> DataFrame:
        made = similarity(residual(with_ops(distances(rows, model, algorithm), model), model))
        shown = {f"ted_{s}": F.col("ted"), f"sim_ratio_{s}": F.col("sim_ratio"), f"ops_{s}": op_counts()["total_ops"], f"{s}_perfect": F.col("residual") == 0}
        return made.select(*rows.columns, *(c.alias(k) for k, c in shown.items()))

    both = backwards(side(backwards(side(pairs, "fwd")), "rv"))
    names = [f"{k}_{s}" for s in ("fwd", "rv") for k in ("ted", "sim_ratio", "ops")] + ["fwd_perfect", "rv_perfect"]
    return both.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(algorithm).alias("algorithm"), *names, F.lit(at or datetime.now()).alias("timestamp"), F.lit(str(model.shown())).alias("cost_model"))


def write_files(texts: DataFrame, path: str, column: str, key: str = "doc_id") -> None:
    """A file for each document, in a folder ``key=...`` of its own below ``path``."""
    texts.select(F.col(key), F.col(column).alias("value")).where("value IS NOT NULL").write.mode("overwrite").partitionBy(key).text(path)


def run(trees: DataFrame, pairs: DataFrame, output: str, costs: CostModel | dict | None = None, algorithm: str = "chawathe") -> DataFrame:
    """Writes trees, scripts, diffs, patched documents and pages of all pairs below
    ``output`` as tables, and patched XML, wikitext and diffs as files; appends the pairs'
    summary, and returns it. Pairs of which a document is missing are left out."""
    model, at = CostModel.of(costs), datetime.now()
    spark = trees.sparkSession
    # Both directions' scripts, written once and read by all that follows.
    whole = with_trees(pairs.select("src", "dst"), trees).where("src_nodes IS NOT NULL AND dst_nodes IS NOT NULL").withColumn("pair", F.monotonically_increasing_id())
    whole.write.mode("overwrite").parquet(f"{output}/pairs")
    whole = spark.read.parquet(f"{output}/pairs")
    scripted = lambda rows: with_ops(distances(rows, model, algorithm), model)
    scripted(whole).withColumn("way", F.lit("fwd")).unionByName(scripted(backwards(whole)).withColumn("way", F.lit("rv"))).write.mode("overwrite").parquet(f"{output}/scripted")
    both = spark.read.parquet(f"{output}/scripted")
    apply(both).withColumn("doc_id", F.concat_ws("->", "src", "dst")).select("doc_id", "nodes").write.mode("overwrite").parquet(f"{output}/patched")
    patched = spark.read.parquet(f"{output}/patched")
    tables = {
        "trees": render.rendered(trees, render.ascii_tree),
        "scripts": script_text(both),
        "diffs": render.diff_documents(both),
        "patched_xml": render.rendered(patched, render.xml_tree, name="xml"),
        "patched_wikitext": render.rendered(patched, render.wikitext),
        "pages": render.infobox_pages(trees),
        "diff_pages": render.diff_page(both.where("way = 'fwd'"), both.where("way = 'rv'"), model.shown(), on=["pair"]),
        "reports": render.report(both, at),
        "summary_rows": summary_rows(whole.drop("pair"), model, algorithm, at),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{output}/{name}")
    for name, column in (("patched_xml", "xml"), ("patched_wikitext", "text")):
        write_files(spark.read.parquet(f"{output}/{name}"), f"{output}/{name}_files", column)
    write_files(spark.read.parquet(f"{output}/diffs").withColumn("doc_id", F.concat_ws("->", "src", "dst")), f"{output}/idf_files", "idf")
    summary = spark.read.parquet(f"{output}/summary_rows")
    summary.write.mode("append").option("header", True).csv(f"{output}/summary")
    return summary


def _named(spark: SparkSession, path: str, names: list[str], strategy: str) -> DataFrame:
    """The trees of the named documents; a name without one ends the program."""
    ids = {x: x.replace(" ", "_") for x in names}
    found = read_documents(spark, path).where(F.col("doc_id").isin(*ids.values()))
    there = {r["doc_id"] for r in found.select("doc_id").collect()}
    if absent := [x for x, i in ids.items() if i not in there]:
        raise SystemExit(f"no document for {', '.join(absent)} below {path}: collect it first")
    return parse_trees(found, strategy=strategy)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description="Compare XML documents as trees.")
    commands = parser.add_subparsers(dest="command", required=True)
    arguments = {"run": ("documents", "source", "target", "output"), "diff": ("documents", "source", "target", "output"), "patch": ("documents", "source", "target", "output"), "postprocess": ("documents", "name", "output"), "collect": ("documents", "pages", "names", "output")}
    for command, names in arguments.items():
        one = commands.add_parser(command)
        for name in names:
            one.add_argument(name)
        one.add_argument("--strategy", default="single_node", choices=STRATEGIES)
        if "source" in names:
            one.add_argument("--algorithm", default="chawathe", choices=ALGORITHMS)
            one.add_argument("--costs")
    commands.choices["patch"].add_argument("--direction", default="forward", choices=("forward", "reverse"))
    commands.choices["collect"].add_argument("--aliases")
    return parser


def main(argv: list[str] | None = None) -> None:
    asked = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "collect":
        aliases = load_aliases(spark, asked.aliases) if asked.aliases else {}
        made = collected(spark.read.parquet(asked.names), spark.read.parquet(asked.pages), read_documents(spark, asked.documents), strategy=asked.strategy, aliases=aliases)
        made.write.mode("overwrite").parquet(asked.output)
        spark.read.parquet(asked.output).select("name", F.col("xml").isNotNull().alias("collected"), "error").show(truncate=False)
        return
    if asked.command == "postprocess":
        write_files(render.infobox_pages(_named(spark, asked.documents, [asked.name], asked.strategy)), asked.output, "html")
        return
    trees = _named(spark, asked.documents, [asked.source, asked.target], asked.strategy)
    costs = load_costs(spark, asked.costs) if asked.costs else CostModel()
    ends = [x.replace(" ", "_") for x in (asked.source, asked.target)]
    if asked.command == "patch" and asked.direction == "reverse":
        ends.reverse()
    pairs = spark.createDataFrame([tuple(ends)], "src string, dst string")
    if asked.command == "run":
        run(trees, pairs, asked.output, costs, asked.algorithm).show(truncate=False)
        return
    scripts = with_ops(distances(with_trees(pairs, trees), costs, asked.algorithm), costs)
    name = F.concat_ws("_to_" if asked.command == "patch" else "__", "src", "dst")
    if asked.command == "diff":
        write_files(render.diff_documents(scripts).withColumn("doc_id", name), asked.output, "idf")
    else:
        write_files(render.rendered(apply(scripts).withColumn("doc_id", name), render.xml_tree, name="xml"), asked.output, "xml")


if __name__ == "__main__":
    main()
