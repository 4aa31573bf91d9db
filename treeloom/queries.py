"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeloom.functions import text as X
from treeloom.functions.wikitext import clean_value, extract_list_items
from treeloom.model import ALGORITHMS
from treeloom.operators import nodes as N
from treeloom.operators.distance import both_ways, distances, similarity, with_trees
from treeloom.operators.patch import apply, refined
from treeloom.operators.script import counted, edit_ops, inverted, preview, script_text, with_ops
from treeloom.operators.semantic import categorised, category, change_summary
from treeloom.operators.shape import build_xml, numbered_pairs
from treeloom.operators.similarity_join import within
from treeloom.plans import render
from treeloom.plans.query_api import Library
from treeloom.plans.run import backwards, summary_rows
from treeloom.sources.catalog import available, collected, resolve
from treeloom.sources.config import CostModel
from treeloom.sources.records import from_fields, from_items
from treeloom.sources.xml import parse_trees

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _field(key: str, value) -> F.Column:
    """A field whose value can't be any field's name."""
    return F.struct(F.lit(key).alias("key"), F.concat(F.lit("v:"), value.cast("string")).alias("value"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """A tree for each order, and the order before it of the same customer."""
    orders = _table(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return orders.withColumn("before", before)


def _order_trees(orders: DataFrame) -> DataFrame:
    c = F.col
    values = F.array(_field("GDP_nominal", F.floor(c("o_totalprice"))), _field("capital", c("o_orderpriority")), _field("legislature", c("o_orderstatus")), _field("HDI_year", F.year("o_orderdate")), _field("note", c("o_custkey")))
    return from_fields(orders, "o_orderkey", "order", values)


def _order_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the one before, both as trees."""
    orders = _orders(spark, d)
    pairs = orders.where("before IS NOT NULL").select(F.col("before").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"))
    return with_trees(pairs, _order_trees(orders))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return with_ops(distances(_order_pairs(spark, d)))


_PAIRS = """WITH o AS (SELECT *, lag(o_orderkey) OVER w AS before, lag(floor(o_totalprice)) OVER w AS p0, lag(o_orderpriority) OVER w AS r0, lag(o_orderstatus) OVER w AS s0, lag(year(o_orderdate)) OVER w AS y0
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
p AS (SELECT CAST(before AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst, p0, floor(o_totalprice) AS p1, CAST(p0 <> floor(o_totalprice) AS BIGINT) AS a, CAST(r0 <> o_orderpriority AS BIGINT) AS b, CAST(s0 <> o_orderstatus AS BIGINT) AS c,
  CAST(y0 <> year(o_orderdate) AS BIGINT) AS e FROM o WHERE before IS NOT NULL)"""


@query(f"{_PAIRS} SELECT src, dst, CAST(a + b + c + e AS DOUBLE) AS ted, 1 / (1 + CAST(a + b + c + e AS DOUBLE)) AS sim_inverse, 1 - CAST(a + b + c + e AS DOUBLE) / 22 AS sim_ratio FROM p")
def order_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each order's record to the one before: the fields that differ."""
    return similarity(distances(_order_pairs(spark, d), matched=False)).select("src", "dst", "ted", "sim_inverse", "sim_ratio")


@query(f"{_PAIRS} SELECT src, dst, CAST(0 AS BIGINT) AS inserts, CAST(0 AS BIGINT) AS deletes, a + b + c + e AS relabels, a + b + c + e AS total_ops, CAST(a + b + c + e AS DOUBLE) AS total_cost FROM p")
def order_op_counts(spark: SparkSession, d: str) -> DataFrame:
    return counted(_scripts(spark, d)).select("src", "dst", "inserts", "deletes", "relabels", "total_ops", "total_cost")


@query(f"""{_PAIRS}, f AS (SELECT unnest([1, 2, 3, 4]) AS k, src, dst, a, b, c, e FROM p)
SELECT ['GDP_nominal', 'capital', 'legislature', 'HDI_year'][k] AS field, ['economic', 'geographic', 'political', 'development'][k] AS category, sum(CASE k WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN c ELSE e END)::BIGINT AS changes FROM f GROUP BY k HAVING changes > 0""")
def order_changes_by_field(spark: SparkSession, d: str) -> DataFrame:
    """Operations of all scripts by the field and category that they touch."""
    return categorised(_scripts(spark, d)).groupBy("field", "category").agg(F.count(F.lit(1)).alias("changes"))


@query(f"{_PAIRS} SELECT src, dst, CAST(p0 AS DOUBLE) AS from_num, CAST(p1 AS DOUBLE) AS to_num, CASE WHEN p1 > p0 THEN 'increase' ELSE 'decrease' END AS direction, abs(p1 - p0) AS abs_diff FROM p WHERE a = 1")
def order_price_moves(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and directions of changed prices."""
    moved = categorised(_scripts(spark, d)).where("field = 'GDP_nominal'")
    return moved.select("src", "dst", "magnitude.from_num", "magnitude.to_num", "magnitude.direction", "magnitude.abs_diff")


@query(f"{_PAIRS} SELECT src, dst, a AS economic, b AS geographic FROM p WHERE a + b + c + e > 0")
def order_change_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes of two categories for each pair that has any change."""
    number = lambda c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("count"))), F.lit(0)).alias(c)
    return change_summary(_scripts(spark, d)).groupBy("src", "dst").agg(number("economic"), number("geographic"))


@query(f"{_PAIRS} SELECT src, dst, 0.0::DOUBLE AS residual, CAST(1 AS BIGINT) AS rounds FROM p")
def order_patches(spark: SparkSession, d: str) -> DataFrame:
    """What is left between each patched order and its target: nothing."""
    return refined(_scripts(spark, d)).select("src", "dst", "residual", F.col("rounds").cast("long").alias("rounds"))


@query(f"{_PAIRS} SELECT src, dst, CAST(11 AS BIGINT) AS n FROM p")
def order_patched_sizes(spark: SparkSession, d: str) -> DataFrame:
    return apply(_scripts(spark, d)).select("src", "dst", F.col("n").cast("long").alias("n"))


@query(f"{_PAIRS} SELECT src, dst, a + b + c + e AS ops, CAST(a + b + c + e AS VARCHAR) AS ted_raw FROM p")
def order_diff_documents(spark: SparkSession, d: str) -> DataFrame:
    """Diff documents: the operations in them and the distance that they state."""
    return render.diff_documents(_scripts(spark, d)).select("src", "dst", F.regexp_count("idf", F.lit("<idf:(insert|delete|relabel) ")).cast("long").alias("ops"), F.regexp_extract("idf", 'ted_raw="([^"]*)"', 1).alias("ted_raw"))


@query(f"{_PAIRS} SELECT 'chawathe' AS algorithm, CAST(0 AS BIGINT) AS asymmetric, sum(CAST(a + b + c + e AS DOUBLE)) AS ted FROM p UNION ALL SELECT 'nierman_jagadish', CAST(0 AS BIGINT), sum(CAST(a + b + c + e AS DOUBLE)) FROM p")
def order_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Both algorithms and directions of all pairs; with unit costs they agree."""
    return both_ways(_order_pairs(spark, d)).groupBy("algorithm").agg(F.count_if("asymmetric").alias("asymmetric"), F.sum("ted_fwd").alias("ted"))


@query(f"{_PAIRS} SELECT src, dst, least(a + b + c + e, 2) AS shown FROM p WHERE a + b + c + e > 0")
def order_previews(spark: SparkSession, d: str) -> DataFrame:
    """The first two operations of each script."""
    return preview(_scripts(spark, d), 2).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shown"))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS b, lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS dst, CAST(levenshtein(a, b) AS DOUBLE) AS ted FROM c WHERE a IS NOT NULL""")
def segment_distances(spark: SparkSession, d: str) -> DataFrame:
    """Trees of letters: their distance is the edit distance of the strings."""
    customers = _table(spark, d, "customer")
    trees = from_items(customers, "c_custkey", "^^", F.split("c_mktsegment", ""))
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    pairs = customers.select(before.cast("string").alias("src"), F.col("c_custkey").cast("string").alias("dst")).where("src IS NOT NULL")
    return distances(with_trees(pairs, trees), matched=False).select("dst", "ted")


@query("WITH b AS (SELECT DISTINCT p_brand AS x FROM part) SELECT a.x AS src, b.x AS dst, CAST(levenshtein(a.x, b.x) AS DOUBLE) AS ted FROM b a JOIN b ON a.x < b.x WHERE levenshtein(a.x, b.x) <= 1")
def brand_similarity_join(spark: SparkSession, d: str) -> DataFrame:
    """Brands within one edit of each other, by the pruned join."""
    brands = _table(spark, d, "part").select("p_brand").distinct()
    return within(from_items(brands, "p_brand", "^^", F.split("p_brand", "")), 1)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, u.k::BIGINT AS node_id, (CASE WHEN u.k = 5 THEN 1 WHEN u.k % 2 = 0 THEN u.k ELSE u.k + 2 END)::BIGINT AS pre, (CASE WHEN u.k = 5 THEN NULL WHEN u.k % 2 = 0 THEN 5 ELSE u.k + 1 END)::BIGINT AS parent_id,
  (CASE WHEN u.k = 5 THEN 5 WHEN u.k % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS subtree_size, CASE u.k WHEN 1 THEN n_name WHEN 2 THEN 'name' WHEN 3 THEN r_name WHEN 4 THEN 'region' ELSE 'nation' END AS label,
  CASE u.k WHEN 1 THEN 'nation/name/' || n_name WHEN 2 THEN 'nation/name' WHEN 3 THEN 'nation/region/' || r_name WHEN 4 THEN 'nation/region' ELSE 'nation' END AS path
FROM nation JOIN region ON n_regionkey = r_regionkey, LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS k) u""")
def nation_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node table of records of nations."""
    nodes = N.to_nodes(_nations(spark, d))
    return nodes.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("node_id", "pre", "parent_id", "subtree_size")), "label", "path")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    joined = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pair = lambda k, c: F.struct(F.lit(k).alias("key"), F.col(c).alias("value"))
    return from_fields(joined, "n_nationkey", "nation", F.array(pair("name", "n_name"), pair("region", "r_name")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, f.label, CASE f.label WHEN 'name' THEN n_name ELSE r_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('name'), ('region')) f(label)")
def nation_fields(spark: SparkSession, d: str) -> DataFrame:
    return N.fields(_nations(spark, d)).select("doc_id", "label", "text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CAST(5 AS BIGINT) AS n_nodes, CAST(3 AS BIGINT) AS n_elements, CAST(2 AS BIGINT) AS n_leaves, 'name,region' AS top_labels FROM nation")
def nation_summary(spark: SparkSession, d: str) -> DataFrame:
    return N.summary(_nations(spark, d))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_name || ' ' || r_name AS leaf_text FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_leaf_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of whole records."""
    return N.leaf_texts(_nations(spark, d)).where("node_id = 5").select("doc_id", "leaf_text")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'land/title/' || n_name AS path FROM nation")
def nation_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Renamed elements and the paths that follow."""
    renamed = N.normalise(_nations(spark, d), {"nation": "land", "name": "title"})
    return N.to_nodes(renamed).where("node_id = 1").select("doc_id", "path")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'nation  (5 nodes)' || chr(10) || '├── name' || chr(10) || '│   └── ' || n_name || '  [leaf]' || chr(10) || '└── region' || chr(10) || '    └── ' || r_name || '  [leaf]' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_text_trees(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered(_nations(spark, d), render.ascii_tree)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, '{{Infobox country' || chr(10) || '| name = ' || n_name || chr(10) || '| region = ' || r_name || chr(10) || '}}' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_wikitext(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered(_nations(spark, d), render.wikitext)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, '<nation><name>' || n_name || '</name><region>' || r_name || '</region></nation>' AS xml FROM nation JOIN region ON n_regionkey = r_regionkey")
def nation_xml(spark: SparkSession, d: str) -> DataFrame:
    return render.rendered(_nations(spark, d), lambda nodes: render.xml_tree(nodes, pretty=False), name="xml")


def _customer_records(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    fields = F.array(pair("name", F.concat(F.lit("[[x|"), F.col("c_name"), F.lit("]]"))), pair("image_flag", F.lit("f")), pair("established_event1", F.col("c_mktsegment")), pair("established_date1", F.lit("")), pair("old", F.lit("{{ubl|a|b}}")))
    return c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.col("c_custkey").cast("string").alias("name"), fields.alias("fields"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '<country name="' || c_custkey || '"><name>' || c_name || '</name><new>a, b</new><established><event><label>' || c_mktsegment || '</label></event></established></country>' AS xml FROM customer""")
def customer_xml(spark: SparkSession, d: str) -> DataFrame:
    """Raw fields, cleaned and shaped into documents."""
    return build_xml(_customer_records(spark, d), aliases={"old": "new"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(10 AS BIGINT) AS n, c_mktsegment AS label FROM customer")
def customer_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Those documents parsed: their sizes, and the label of the event's leaf."""
    trees = parse_trees(build_xml(_customer_records(spark, d), aliases={"old": "new"}))
    leaf = F.get(F.filter("nodes", lambda x: F.col("doc_id").isNotNull() & (x["path"].startswith("country/established/event/label/"))), 0)["label"]
    return trees.select("doc_id", F.col("n").cast("long").alias("n"), leaf.alias("label"))


@query("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS number, max(l_returnflag) AS label, max(l_linestatus) AS value FROM lineitem GROUP BY 1, 2")
def lineitem_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Numbered pairs of fields, put together again."""
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.concat(F.lit("leader_title"), "l_linenumber").alias("key"), F.col("l_returnflag").alias("value")), F.struct(F.concat(F.lit("leader_name"), "l_linenumber").alias("key"), F.col("l_linestatus").alias("value")))).alias("x")).select("doc_id", "x.*")
    return numbered_pairs(rows, "leader_title", "leader_name").select("doc_id", F.col("number").cast("long").alias("number"), "label", "value")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT) AS tokens, coalesce(regexp_extract_all(text, '[A-Za-z0-9]+')[1], '') AS first FROM documents")
def document_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = X.tokenize("text")
    return _table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("first"))


@query("SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]+/?>', '', 'g') AS text FROM pages")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages without comments and tags."""
    return _table(spark, d, "pages").select("page_id", X.strip_tags(X.strip_comments("html")).alias("text"))


@query("SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def benchmark_lines(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select("item_id", X.normalise_whitespace("text").alias("text"))


@query("SELECT event_id, TRY_CAST(replace(regexp_replace(props, '[^0-9.,\\-]', '', 'g'), ',', '') AS DOUBLE) AS number FROM events")
def event_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", X.parse_number("props").alias("number"))


@query("SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'seen' WHEN event_type LIKE 'p%' THEN 'bought' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY event_type")
def event_categories(spark: SparkSession, d: str) -> DataFrame:
    kinds = category("event_type", {"seen": ["click", "view"], "bought": ["p*"]})
    return _table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", kinds.alias("category"), "n")


@query("SELECT p_partkey, regexp_replace(p_type, '[^a-zA-Z0-9_.-]', '_', 'g') AS tag, regexp_matches(lower(p_type), '^(label|data|alt_|image_|today$)') OR p_type LIKE '%\\_ref' ESCAPE '\\' AS dropped FROM part")
def part_tags(spark: SparkSession, d: str) -> DataFrame:
    """Names as tags, and whether fields of such names would be left out."""
    return _table(spark, d, "part").select("p_partkey", X.safe_tag("p_type").alias("tag"), X.is_dropped_field(F.lower("p_type")).alias("dropped"))


@query("SELECT replace(n_name, '_', ' ') AS name FROM nation")
def nation_names(spark: SparkSession, d: str) -> DataFrame:
    return available(_table(spark, d, "nation"), "n_name")


@query(f"{_PAIRS}, t AS (SELECT src, dst, unnest([a, b, c, e]) AS x FROM p) SELECT op_type, n FROM (SELECT 'relabel' AS op_type, sum(x)::BIGINT AS n FROM t) WHERE n > 0")
def operations_by_type(spark: SparkSession, d: str) -> DataFrame:
    return edit_ops(_scripts(spark, d)).groupBy("op_type").agg(F.count(F.lit(1)).alias("n"))


#: Insertions cost 1, deletions 2; a relabel 1, or 0.5 between leaves and 2.5 otherwise.
PRICES = CostModel(1, 2, 1, 2.5, 0.5)


def _line_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the one before, as trees: the priority above a leaf that all have and
    one for each of its lines, which is the line's place and the order's status. So numbers
    of nodes differ, and roots match roots."""
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("int").alias("k"))
    orders = _orders(spark, d).join(lines, "o_orderkey", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    places = F.when(F.col("k") > 0, F.sequence(F.lit(1), "k")).otherwise(F.array().cast("array<int>"))
    trees = from_items(orders, "o_orderkey", F.col("o_orderpriority"), F.concat(F.array(F.lit("lines")), F.transform(places, lambda x: F.concat(x.cast("string"), "o_orderstatus"))))
    pairs = orders.where("before IS NOT NULL").select(F.col("before").cast("string").alias("src"), F.col("o_orderkey").cast("string").alias("dst"))
    return with_trees(pairs, trees)


def _line_scripts(spark: SparkSession, d: str, algorithm: str = "chawathe") -> DataFrame:
    return with_ops(distances(_line_pairs(spark, d), PRICES, algorithm), PRICES)


# k0, k1: lines; r: whether the root is relabelled; c: relabelled, i: new, e: deleted leaves.
_LINES = """WITH n AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1),
o AS (SELECT *, coalesce(k, 0) AS k1, lag(o_orderkey) OVER w AS before, lag(coalesce(k, 0)) OVER w AS k0, lag(o_orderpriority) OVER w AS p0, lag(o_orderstatus) OVER w AS s0
  FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
l AS (SELECT CAST(before AS VARCHAR) AS src, CAST(o_orderkey AS VARCHAR) AS dst, k0, k1, p0, o_orderpriority AS p1, s0, o_orderstatus AS s1, CAST(p0 <> o_orderpriority AS BIGINT) AS r,
  CASE WHEN s0 <> o_orderstatus THEN least(k0, k1) ELSE 0 END AS c, greatest(k1 - k0, 0) AS i, greatest(k0 - k1, 0) AS e FROM o WHERE before IS NOT NULL),
x AS (SELECT *, i + 2 * e + r + c AS one, i + 2 * e + 2.5 * r + 0.5 * c AS two, e + 2 * i + r + c AS one_back, e + 2 * i + 2.5 * r + 0.5 * c AS two_back FROM l)"""
# The script's lines: relabelled leaves, the relabelled root, deletions, insertions.
_STEPS = """s AS (SELECT *, c + r + e + i AS n, [t || s0 || ' -> ' || t || s1 FOR t IN range(1, c + 1)] AS a, CASE WHEN r = 1 THEN [p0 || ' -> ' || p1] ELSE [] END AS b,
  [t || s0 FOR t IN range(k1 + 1, k0 + 1)] AS f, [t || s1 FOR t IN range(k0 + 1, k1 + 1)] AS g FROM x)"""


@query(f"{_LINES} SELECT src, dst, 'chawathe' AS algorithm, CAST(one AS DOUBLE) AS ted FROM x UNION ALL SELECT src, dst, 'nierman_jagadish', CAST(two AS DOUBLE) FROM x")
def order_line_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of trees of different sizes, where each kind of operation has its price."""
    pairs = _line_pairs(spark, d)
    one, two = (distances(pairs, PRICES, x, matched=False).select("src", "dst", "algorithm", "ted") for x in ALGORITHMS)
    return one.unionByName(two)


@query(f"{_LINES} SELECT src, dst, i::BIGINT AS inserts, e::BIGINT AS deletes, (r + c)::BIGINT AS relabels, (i + e + r + c)::BIGINT AS total_ops, CAST(two AS DOUBLE) AS total_cost FROM x")
def order_line_op_counts(spark: SparkSession, d: str) -> DataFrame:
    """Operations of the scripts under split prices, and what they cost."""
    return counted(_line_scripts(spark, d, "nierman_jagadish")).select("src", "dst", "inserts", "deletes", "relabels", "total_ops", "total_cost")


@query(f"{_LINES}, t AS (SELECT *, unnest(range(k0 + 1, k1 + 1)) AS t FROM x) SELECT src, dst, (r + c + t - k0)::BIGINT AS op_seq, t || s1 AS label, t::BIGINT AS position, p1 AS parent_path, (k0 + 2)::BIGINT AS src_parent, 1.0::DOUBLE AS cost FROM t")
def order_line_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Inserted nodes: their places among their siblings, and the nodes they go below."""
    ops = edit_ops(_line_scripts(spark, d)).where("op_type = 'insert'")
    return ops.select("src", "dst", F.col("op_seq").cast("long").alias("op_seq"), "label", F.col("position").cast("long").alias("position"), "parent_path", F.col("src_parent").cast("long").alias("src_parent"), "cost")


@query(f"{_LINES}, t AS (SELECT *, unnest(range(k1 + 1, k0 + 1)) AS t FROM x) SELECT src, dst, (r + c + t - k1)::BIGINT AS op_seq, t || s0 AS label, p0 || '/' || t || s0 AS path, 2.0::DOUBLE AS cost FROM t")
def order_line_deletes(spark: SparkSession, d: str) -> DataFrame:
    ops = edit_ops(_line_scripts(spark, d)).where("op_type = 'delete'")
    return ops.select("src", "dst", F.col("op_seq").cast("long").alias("op_seq"), "label", "path", "cost")


@query(f"""{_LINES}, {_STEPS} SELECT src, dst, array_to_string(list_concat(['EditScript — ' || n || ' ops, cost=' || one], [ '  ' || u || '. ' || CASE WHEN u <= c + r THEN 'RELABEL ' ELSE CASE WHEN u <= c + r + e THEN 'DELETE ' ELSE 'INSERT ' END END
  || list_concat(a, b, f, g)[u] || ' (cost=' || CASE WHEN u > c + r AND u <= c + r + e THEN 2 ELSE 1 END || ')' FOR u IN range(1, n + 1)]), chr(10)) AS script FROM s""")
def order_line_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Whole scripts as text."""
    return script_text(_line_scripts(spark, d))


@query(f"{_LINES} SELECT src, dst, 0.0::DOUBLE AS residual, 1::BIGINT AS rounds FROM x")
def order_line_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Scripts of insertions and deletions patched: nothing is left, after one round."""
    return refined(_line_scripts(spark, d), PRICES).select("src", "dst", "residual", F.col("rounds").cast("long").alias("rounds"))


@query(f"{_LINES} SELECT src, dst, (k1 + 2)::BIGINT AS n, array_to_string(list_concat(['lines'], [t || s1 FOR t IN range(1, k1 + 1)], [p1]), ' ') AS labels FROM x")
def order_line_patched(spark: SparkSession, d: str) -> DataFrame:
    """The patched trees' nodes in postorder."""
    return apply(_line_scripts(spark, d)).select("src", "dst", F.col("n").cast("long").alias("n"), F.array_join("nodes.label", " ").alias("labels"))


@query(f"{_LINES} SELECT dst AS src, src AS dst, e::BIGINT AS inserts, i::BIGINT AS deletes, CAST(one_back AS DOUBLE) AS total_cost, (k0 + 2)::BIGINT AS n, array_to_string(list_concat(['lines'], [t || s0 FOR t IN range(1, k0 + 1)], [p0]), ' ') AS labels FROM x")
def order_line_inverses(spark: SparkSession, d: str) -> DataFrame:
    """Scripts turned around, and the targets that they patch back into the sources."""
    made = apply(inverted(_line_scripts(spark, d), PRICES))
    number = lambda kind: F.size(F.filter("ops", lambda x: x["op_type"] == kind)).cast("long")
    return made.select("src", "dst", number("insert").alias("inserts"), number("delete").alias("deletes"), F.aggregate("ops", F.lit(0.0), lambda acc, x: acc + x["cost"]).alias("total_cost"), F.col("n").cast("long").alias("n"), F.array_join("nodes.label", " ").alias("labels"))


@query(f"{_LINES} SELECT src, dst, 'chawathe' AS algorithm, CAST(one AS DOUBLE) AS ted_fwd, CAST(one_back AS DOUBLE) AS ted_rv, one <> one_back AS asymmetric FROM x UNION ALL SELECT src, dst, 'nierman_jagadish', CAST(two AS DOUBLE), CAST(two_back AS DOUBLE), two <> two_back FROM x")
def order_line_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Directions differ where one inserts and the other deletes."""
    return both_ways(_line_pairs(spark, d), PRICES)


@query(f"{_LINES} SELECT src AS source, dst AS target, CAST(one AS DOUBLE) AS ted_fwd, CAST(one_back AS DOUBLE) AS ted_rv, (i + e + r + c)::BIGINT AS ops_fwd, (i + e + r + c)::BIGINT AS ops_rv, 1 - CAST(one AS DOUBLE) / (k0 + k1 + 4) AS sim_ratio_fwd, true AS fwd_perfect, true AS rv_perfect FROM x")
def order_line_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of whole runs, a row for each pair."""
    return summary_rows(_line_pairs(spark, d), PRICES).select("source", "target", "ted_fwd", "ted_rv", "ops_fwd", "ops_rv", "sim_ratio_fwd", "fwd_perfect", "rv_perfect")


@query(f"""{_LINES}, {_STEPS} SELECT src, dst, '<?xml version="1.0" ?>' || chr(10) || '<idf:diff xmlns:idf="urn:idpa:diff:1.0" source="' || src || '" target="' || dst || '" algorithm="chawathe" ted_raw="' || one || '" sim_inverse="' || printf('%.6f', 1 / (1 + one)) || '" sim_ratio="' || printf('%.6f', 1 - one / (k0 + k1 + 4)) || '">' || chr(10)
  || '  <idf:operations count="' || n || '">' || chr(10) || array_to_string(list_concat(
  ['    <idf:relabel id="op' || u || '" path="' || p0 || CASE WHEN u <= c THEN '/' || u || s0 ELSE '' END || '">' || chr(10) || '      <idf:from>' || split_part(list_concat(a, b)[u], ' -> ', 1) || '</idf:from>' || chr(10) || '      <idf:to>' || split_part(list_concat(a, b)[u], ' -> ', 2) || '</idf:to>' || chr(10) || '    </idf:relabel>' || chr(10) FOR u IN range(1, c + r + 1)],
  ['    <idf:delete id="op' || (c + r + u) || '">' || chr(10) || '      <idf:node label="' || f[u] || '" node_type="leaf" path="' || p0 || '/' || f[u] || '"/>' || chr(10) || '    </idf:delete>' || chr(10) FOR u IN range(1, e + 1)],
  ['    <idf:insert id="op' || (c + r + u) || '" parent_path="' || p1 || '" position="' || (k0 + u) || '">' || chr(10) || '      <idf:node label="' || g[u] || '" node_type="leaf"/>' || chr(10) || '    </idf:insert>' || chr(10) FOR u IN range(1, i + 1)]), '') || '  </idf:operations>' || chr(10) || '</idf:diff>' || chr(10) AS idf FROM s""")
def order_line_diff_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole diff documents."""
    return render.diff_documents(_line_scripts(spark, d))


@query(f"{_LINES} SELECT src, dst, (i + e)::BIGINT AS inserts, (i + e)::BIGINT AS deletes, (2 * (r + c))::BIGINT AS relabels, one::VARCHAR AS cost FROM x")
def order_line_diff_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of both directions: the operations on them, and the cost stated first."""
    pairs = _line_pairs(spark, d)
    back = with_ops(distances(backwards(pairs), PRICES), PRICES)
    number = lambda kind: F.regexp_count("html", F.lit(f'<tr class="{kind}">')).cast("long").alias(f"{kind}s")
    pages = render.diff_page(_line_scripts(spark, d), back, PRICES.shown())
    return pages.select("src", "dst", *map(number, ("insert", "delete", "relabel")), F.regexp_extract("html", ", cost ([0-9.]+)</p>", 1).alias("cost"))


@query(f"""{_LINES}, {_STEPS} SELECT src, dst, '# Country Comparison: ' || src || ' vs ' || dst || chr(10) || '*Generated: 2000-01-01 00:00*' || chr(10) || chr(10) || '## Structural Similarity (TED)' || chr(10) || '- **Tree Edit Distance**: ' || one || '.0' || chr(10) || '- **' || src || ' nodes**: ' || (k0 + 2) || ', **' || dst || ' nodes**: ' || (k1 + 2) || chr(10)
  || '- **Similarity (inverse)**: ' || printf('%.4f', 1 / (1 + one)) || chr(10) || '- **Similarity (ratio)**: ' || printf('%.4f', 1 - one / (k0 + k1 + 4)) || chr(10) || chr(10) || '## Edit Operations (' || n || ' total)' || chr(10) || '- Inserts: ' || i || chr(10) || '- Deletes: ' || e || chr(10) || '- Relabels: ' || (r + c) || chr(10) || chr(10) || '## Changes by Category' || chr(10)
  || CASE WHEN n = 0 THEN '' ELSE chr(10) || '### Other (' || n || ' changes: ' || i || 'ins, ' || e || 'del, ' || (r + c) || 'rel)' || chr(10) || array_to_string(list_concat(
  ['- **relabel** `' || split_part(list_concat(a, b)[u], ' -> ', 1) || '`: `' || split_part(list_concat(a, b)[u], ' -> ', 1) || '` → `' || split_part(list_concat(a, b)[u], ' -> ', 2) || '`' FOR u IN range(1, c + r + 1)],
  ['- **delete** `' || u || '` (`' || u || '`)' FOR u IN f], ['- **insert** `' || u || '` (`' || u || '`)' FOR u IN g])[1:5], chr(10)) || CASE WHEN n > 5 THEN chr(10) || '- *... and ' || (n - 5) || ' more*' ELSE '' END END AS report FROM s""")
def order_line_reports(spark: SparkSession, d: str) -> DataFrame:
    """Whole comparisons in Markdown."""
    return render.report(_line_scripts(spark, d), datetime(2000, 1, 1))


@query(f"{_LINES} SELECT CASE WHEN t = 1 THEN 'insert' WHEN t = 2 THEN 'delete' ELSE 'relabel' END AS op_type, sum(CASE t WHEN 1 THEN i WHEN 2 THEN e ELSE r + c END)::BIGINT AS n, CAST(sum(CASE t WHEN 1 THEN i WHEN 2 THEN 2 * e ELSE 2.5 * r + 0.5 * c END) AS DOUBLE) AS cost FROM x, (SELECT unnest([1, 2, 3]) AS t) GROUP BY t HAVING n > 0")
def order_line_operations_by_type(spark: SparkSession, d: str) -> DataFrame:
    ops = edit_ops(_line_scripts(spark, d, "nierman_jagadish"))
    return ops.groupBy("op_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><meta charset="UTF-8"><title>' || n_nationkey || '</title></head><body><table class="infobox"><tr><td colspan="2" class="name">' || n_nationkey || '</td></tr><tr><td colspan="2" class="sub">s</td></tr><tr><td colspan="2" class="section">Other</td></tr><tr><th>Name</th><td>' || n_name
  || '</td></tr><tr><th>Region</th><td>' || r_name || '</td></tr><tr><td colspan="2" class="foot">5 nodes</td></tr></table></body></html>' || chr(10) AS html FROM nation JOIN region ON n_regionkey = r_regionkey""")
def nation_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records as pages."""
    return render.infobox_pages(_nations(spark, d), "s")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en"><head><meta charset="UTF-8"><title>' || c_custkey || '</title></head><body><table class="infobox"><tr><td colspan="2" class="name">' || c_custkey || '</td></tr><tr><td colspan="2" class="section">Established</td></tr><tr><th>' || c_mktsegment || '</th><td></td></tr><tr><td colspan="2" class="section">Other</td></tr><tr><th>Name</th><td>' || c_name
  || '</td></tr><tr><th>New</th><td>a, b</td></tr><tr><td colspan="2" class="foot">10 nodes</td></tr></table></body></html>' || chr(10) AS html FROM customer""")
def customer_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of parsed documents, with their groups."""
    return render.infobox_pages(parse_trees(build_xml(_customer_records(spark, d), aliases={"old": "new"})))


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, '{{Infobox country' || chr(10) || '| name = ' || c_name || chr(10) || '| new = {{unbulleted list|a|b}}' || chr(10) || '| established_events =' || chr(10) || '| established_event1 = ' || c_mktsegment || chr(10) || '}}' AS text FROM customer")
def customer_wikitext(spark: SparkSession, d: str) -> DataFrame:
    """Documents with items for the values of lists, as wikitext again."""
    return render.rendered(parse_trees(build_xml(_customer_records(spark, d), aliases={"old": "new"}, strategy="token_nodes")), render.wikitext)


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, len(regexp_extract_all(c_custkey || ' ' || c_name || ' a b ' || c_mktsegment, '[A-Za-z0-9]+')) AS n_leaves FROM customer")
def customer_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents parsed into a leaf for each token; an attribute is one leaf."""
    trees = parse_trees(build_xml(_customer_records(spark, d), aliases={"old": "new"}), strategy="token_nodes")
    return trees.select("doc_id", F.size(F.filter("nodes", lambda x: x["node_type"] == "leaf")).cast("long").alias("n_leaves"))


@query("SELECT c_name AS name, c_name AS doc_id, '<country name=\"' || c_name || '\"><segment>' || c_mktsegment || '</segment></country>' AS xml, CAST(NULL AS VARCHAR) AS error FROM customer UNION ALL SELECT s_name, replace(s_name, ' ', '_'), NULL, 'no infobox for ' || s_name FROM supplier")
def customers_collected(spark: SparkSession, d: str) -> DataFrame:
    """Customers, suppliers and nations asked for: customers have pages with a template that
    fits, suppliers others, nations are documents already."""
    customers, suppliers, nations = (_table(spark, d, x) for x in ("customer", "supplier", "nation"))
    names = customers.select(F.col("c_name").alias("name")).unionByName(suppliers.select(F.col("s_name").alias("name"))).unionByName(nations.select(F.col("n_name").alias("name")))
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    template = lambda name, value: F.struct(F.lit(name).alias("template"), F.array(field("template", F.lit("t")), field("segment", value)).alias("fields"))
    fetched = customers.select(F.col("c_name").alias("name"), F.array(template("other", F.lit("x")), template("Infobox Country 2", F.concat(F.lit("[["), "c_mktsegment", F.lit("]]"))), template("infobox country", F.lit("y"))).alias("templates"))
    fetched = fetched.unionByName(suppliers.select(F.col("s_name").alias("name"), F.array(template("other", F.col("s_name"))).alias("templates")))
    made = collected(names, fetched, nations.select(F.col("n_name").alias("doc_id")))
    return made.select("name", "doc_id", "xml", "error")


@query("SELECT DISTINCT lower(c_name) AS name, c_name AS doc_id FROM customer UNION ALL SELECT DISTINCT ' ' || c_name, c_name FROM customer UNION ALL SELECT n_name, NULL FROM nation")
def customer_names_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Names in another case, names with spaces around them, and names of no document."""
    customers = _table(spark, d, "customer")
    asked = customers.select(F.lower("c_name").alias("name")).unionByName(customers.select(F.concat(F.lit(" "), "c_name").alias("name"))).unionByName(_table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return resolve(asked, customers.select(F.col("c_name").alias("doc_id")))


@query("SELECT p_partkey, p_name || p_brand || p_type || ' |y' AS text FROM part")
def part_notes_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Values without their references, citations, notes, templates, comments and tags."""
    raw = F.concat(F.lit("[[x|"), "p_name", F.lit("]]<!-- c -->{{efn|a {{b}}}}<ref name=r/>{{cite web|url=u}}<ref>q</ref>"), "p_brand", F.lit("{{Cite_book|t}}{{small|s}}<b>"), "p_type", F.lit("</b>|efn|z\n |y"))
    return _table(spark, d, "part").select("p_partkey", clean_value(raw).alias("text"))


@query("SELECT p_partkey, p_brand || ', ' || p_type || ', ' || p_size || p_name AS text FROM part")
def part_lists_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Values with their lists expanded, without noise among the items and without trees."""
    raw = F.concat(F.lit("{{plainlist|\n* "), "p_brand", F.lit("\n* "), "p_type", F.lit("\n|efn| name = x |url|[[q|"), F.col("p_size").cast("string"), F.lit("]]}}{{Tree list}}\n* a\n{{Tree list/end}}"), "p_name")
    return _table(spark, d, "part").select("p_partkey", clean_value(raw).alias("text"))


@query("SELECT p_partkey, p_brand || ';' || p_type || ';' || p_size AS items, 3::BIGINT AS n FROM part")
def part_items(spark: SparkSession, d: str) -> DataFrame:
    """Values as their items, bullets and bars alike."""
    raw = F.concat(F.lit("{{unbulleted list|"), "p_brand", F.lit("|ref|\n* "), "p_type", F.lit("\n** [[q|"), F.col("p_size").cast("string"), F.lit("]]\n}}<!-- c -->"))
    items = extract_list_items(raw)
    return _table(spark, d, "part").select("p_partkey", items.alias("x")).select("p_partkey", F.array_join("x", ";").alias("items"), F.size("x").cast("long").alias("n"))


def _library(spark: SparkSession, d: str) -> Library:
    """Nations, whose ids are their keys."""
    return Library(_nations(spark, d))


_TWO = "WITH t AS (SELECT n_nationkey AS k, n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT a.n AS n0, a.r AS r0, b.n AS n1, b.r AS r1, CAST(a.n <> b.n AS BIGINT) + CAST(a.r <> b.r AS BIGINT) AS ted FROM t a, t b WHERE a.k = 3 AND b.k = 7)"


@query(f"{_TWO} SELECT '3' AS name, 5::BIGINT AS node_count, 2::BIGINT AS field_count, f.p::BIGINT AS pos, f.f AS field, CASE f.p WHEN 0 THEN n0 ELSE r0 END AS text, CAST(NULL AS VARCHAR) AS error FROM p, (VALUES (0, 'name'), (1, 'region')) f(p, f) UNION ALL SELECT 'nowhere', NULL, 0, NULL, NULL, NULL, 'no data for nowhere'")
def api_document_info(spark: SparkSession, d: str) -> DataFrame:
    library = _library(spark, d)
    rows = library.document_info("3").unionByName(library.document_info("nowhere"))
    return rows.select("name", F.col("node_count").cast("long").alias("node_count"), "field_count", F.col("pos").cast("long").alias("pos"), "field", "text", "error")


@query(f"{_TWO} SELECT '3' AS src, '7' AS dst, CAST(NULL AS VARCHAR) AS error, 5::BIGINT AS t1_nodes, 5::BIGINT AS t2_nodes, CAST(ted AS DOUBLE) AS ted, 1 / (1 + CAST(ted AS DOUBLE)) AS sim_inverse, 1 - CAST(ted AS DOUBLE) / 10 AS sim_ratio, 0::BIGINT AS inserts, 0::BIGINT AS deletes, ted AS relabels, ted AS total_ops FROM p UNION ALL SELECT '3', 'nowhere', 'no data for nowhere', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
def api_compare(spark: SparkSession, d: str) -> DataFrame:
    library = _library(spark, d)
    rows = library.compare("3", "7").unionByName(library.compare("3", "nowhere"))
    return rows.select("src", "dst", "error", F.col("t1_nodes").cast("long").alias("t1_nodes"), F.col("t2_nodes").cast("long").alias("t2_nodes"), "ted", "sim_inverse", "sim_ratio", "inserts", "deletes", "relabels", "total_ops")


@query(f"{_TWO}, c AS (SELECT unnest([0, 1]) AS i, n0, n1, r0, r1, ted FROM p) SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS index, 'relabel' AS op, CASE i WHEN 0 THEN 'name' ELSE 'region' END AS field, 'other' AS category, CASE i WHEN 0 THEN n0 ELSE r0 END AS node_label, CASE i WHEN 0 THEN n1 ELSE r1 END AS to, ted AS category_total, ted AS total_operations, false AS truncated FROM c WHERE i = 0 OR r0 <> r1")
def api_script_details(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).script_details("3", "7").select("index", "op", "field", "category", "node_label", "to", "category_total", "total_operations", "truncated")


@query(f"{_TWO} SELECT 'NAME' AS asked, 'name' AS field, n0 AS value, 1::BIGINT AS child_count, NULL AS similar_fields, CAST(NULL AS VARCHAR) AS available_fields, CAST(NULL AS VARCHAR) AS error FROM p UNION ALL SELECT 'reg', 'reg', NULL, NULL, 'region', NULL, 'field not found' UNION ALL SELECT 'zzz', 'zzz', NULL, NULL, NULL, 'name,region', 'field not found'")
def api_field_value(spark: SparkSession, d: str) -> DataFrame:
    library = _library(spark, d)
    one = lambda f: library.field_value("3", f).select(F.lit(f).alias("asked"), "field", "value", "child_count", F.array_join("similar_fields", ",").alias("similar_fields"), F.array_join("available_fields", ",").alias("available_fields"), "error")
    return one("NAME").unionByName(one("reg")).unionByName(one("zzz"))


@query(f"{_TWO} SELECT 0::BIGINT AS pos, 'Region' AS field, r0 AS value1, r1 AS value2, r0 = r1 AS same FROM p UNION ALL SELECT 1, 'name', n0, n1, n0 = n1 FROM p UNION ALL SELECT 2, 'none', '(not present)', '(not present)', NULL")
def api_compare_fields(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).compare_fields("3", "7", ["Region", "name", "none"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"{_TWO} SELECT 'other' AS category, ted AS count, ted AS relabels, CAST(ted AS DOUBLE) AS raw_ted, 1 - CAST(ted AS DOUBLE) / 10 AS sim_ratio FROM p")
def api_semantic_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).semantic_similarity("3", "7").select("category", "count", "relabels", "raw_ted", "sim_ratio")


@query(f"{_TWO} SELECT '3' AS src, '7' AS dst, '## Edit Operations (' || ted || ' total)' AS operations, '### Other (' || ted || ' changes: 0ins, 0del, ' || ted || 'rel)' AS category FROM p")
def api_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _library(spark, d).report("3", "7")
    return rows.select("src", "dst", F.regexp_extract("report", "(?m)^## Edit Operations .*$", 0).alias("operations"), F.regexp_extract("report", "(?m)^### .*$", 0).alias("category"))


@query("SELECT replace(CAST(n_nationkey AS VARCHAR), '_', ' ') AS name FROM nation")
def api_list_documents(spark: SparkSession, d: str) -> DataFrame:
    return _library(spark, d).list_documents()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Regions as trees of their nations, and the distance of each to the next."""
    nations = _table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    joined = _table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    trees = from_items(joined, "r_name", "region", F.col("names"))
    after = F.lead("r_name").over(Window.partitionBy(F.lit(0)).orderBy("r_name"))
    pairs = _table(spark, d, "region").select(F.col("r_name").alias("src"), after.alias("dst")).where("dst IS NOT NULL")
    return similarity(distances(with_trees(pairs, trees), matched=False)).select("src", "dst", "ted", "sim_inverse", "sim_ratio")
