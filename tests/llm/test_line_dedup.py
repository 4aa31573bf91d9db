import random
import re

import duckdb
from pyspark.sql import functions as F

from treeloom.llm.line_dedup import SQL, _words, dedup_lines, has_word, op3, rarity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, num=4, den=5):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in t.split("\n"):
            words = set(WORD.findall(line))
            if not words:
                kept.append(line)
                continue
            if not any(den * len(words & s) >= num * len(words | s) for s in seen):
                kept.append(line)
            seen.append(words)
        out[i] = (len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    lines = [" ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 9, 15, 30]))) for _ in range(50)]
    rows = []
    for i in range(n):
        mine = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(lines).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            rng.shuffle(line) if rng.random() < 0.2 else None
            mine.append(rng.choice([" ", "\t", "  "]).join(line))
        mine.insert(0, "") if rng.random() < 0.3 else None
        rows.append((i, "\n".join(mine)))
    return rows


def found(df, **more):
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in dedup_lines(df, **more).collect()}


def test_same_as_brute_force(spark):
    for seed, (num, den) in enumerate([(4, 5), (1, 2)]):
        rows = corpus(seed)
        assert found(spark.createDataFrame(rows, "doc_id long, text string"), num=num, den=den) == plain(rows, num, den)


def test_same_as_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    wanted = {r[0]: tuple(r[1:]) for r in db.sql(SQL).fetchall()}
    assert found(spark.read.parquet(path)) == wanted


def test_edges(spark):
    rows = [(1, "a b c d e\n\nx", 1), (2, None, 1), (3, "", 1), (4, "e d c b a", 1), (5, "y\ny", 1), (5, "y\ny", 1), (None, "x", 1), (6, "long " * 30_000 + "\nlong", 1), (7, "\n".join(f"l{k} m{k}" for k in range(5000)), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, no int")
    out = sorted(map(tuple, op3(df).collect()), key=str)
    assert out == sorted(
        [(1, 3, 1, "a b c d e\n"), (2, 0, 0, None), (3, 1, 0, ""), (4, 1, 1, ""), (5, 2, 1, "y"), (5, 2, 1, "y"), (None, 1, 0, "x"), (6, 2, 1, "long " * 30_000), (7, 5000, 0, rows[8][1])], key=str
    )
    assert op3(df.where("false")).collect() == []
    least = spark.createDataFrame([(-(1 << 63), "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted(map(tuple, op3(least).collect()), key=str) == sorted([(None, 1, 0, "a b"), (-(1 << 63), 1, 1, ""), (3, 1, 1, "")], key=str)
    assert op3(df.where("text IS NULL")).count() == 1


def test_words_by_any_white_space(spark):
    lines = ["a b", " a  b ", "a\tb c", "a\rb", "a \x0b\x0c b", "a\xa0b c", "", "  ", "b\r"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", _words(F.col("line")).alias("w")).collect()
    assert {r["line"]: r["w"] for r in rows} == {x: WORD.findall(x) for x in lines}
    texts = [(k, f"a{x}b{x}c{x}d{x}e{k}\nq{k}") for k, x in enumerate(["\t", " ", "\r", "  ", "\x0b\x0c", " \t"])]
    assert found(spark.createDataFrame(texts, "doc_id long, text string"), num=1, den=2) == plain(texts, 1, 2)


def test_words_are_counted_before_rows_are_added(spark):
    """Words are most of the rows; they go into their counts without a union between."""
    docs = spark.createDataFrame([(1, "a b\na")], "id long, text string")
    plan = spark.range(1).select(rarity(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Union", 1)[1]
    levels = spark.range(1).select(rarity(docs).alias("x")).first()["x"]
    assert sorted(x for x in levels if x) == [3, 4] and len(levels) == 1 << 17


def test_lines_with_a_word_without_regular_expressions(spark):
    lines = ["", " ", "\t", "\x0b\x0c\r", "\n \n", "a", " a", "\tb\r", "\xa0", "\u2003", "\x1c", "\x85"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    assert {r["text"]: r["y"] for r in df.select("text", has_word(F.col("text")).alias("y")).collect()} == {x: bool(WORD.search(x)) for x in lines}
    assert "RLIKE" not in dedup_lines(df)._jdf.queryExecution().optimizedPlan().toString()
