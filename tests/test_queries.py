"""Every query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from treeloom.queries import QUERIES, SQL

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    found = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)
    result = db.sql(SQL[name])
    places = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    wanted = sorted((tuple(r[k] for k in places) for r in result.fetchall()), key=repr)
    assert found == wanted and found


@pytest.mark.parametrize("name", ["order_line_reports", "order_line_diff_documents"])
def test_similarities_that_are_ties(spark, tmp_path, name):
    """1 / 32 has five places, 65 / 128 seven, and both end with a 5 after an even digit."""
    orders = [(1, 1, "O", "a", 16), (2, 1, "F", "b", 2), (3, 2, "O", "a", 62), (4, 2, "F", "b", 62)]
    rows = ", ".join(f"({k}, {c}, '{s}', '{p}')" for k, c, s, p, _ in orders)
    lines = ", ".join(f"({k}, {i})" for k, *_, n in orders for i in range(1, n + 1))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_orderpriority FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_orderpriority)")
    con.execute(f"CREATE TABLE lineitem AS SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber FROM (VALUES {lines}) t(l_orderkey, l_linenumber)")
    for table in ("orders", "lineitem"):
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    wanted = sorted(map(tuple, con.sql(SQL[name]).fetchall()))
    assert ("0.0312\n" if name == "order_line_reports" else "0.507812") in "".join(r[2] for r in wanted)
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == wanted


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(entry.queries())
