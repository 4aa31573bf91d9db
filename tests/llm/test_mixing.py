import random
from collections import defaultdict

from treeloom.llm.mixing import mix, op6, targets


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not above:
            return out
        capped |= above


def documents(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Ä", "z", None])
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 60]))) if rng.random() > 0.02 else None, source, 7))
    rows += [(5000, "tiny", "lone", 7), (None, "x y", "b", 7), (None, "x y", "b", 7), (3, "a b c", "a", 7), (5001, None, "void", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target long"), rows


def test_targets_and_taken(spark):
    df, rows = documents(spark)
    out = op6(df).collect()
    assert len(out) == len(rows)
    sizes, wanted, got, most = defaultdict(int), None, defaultdict(int), defaultdict(int)
    for i, t, s, _ in rows:
        sizes[s] += len((t or "").split())
        most[s] = max(most[s], len((t or "").split()))
    wanted = plain_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * max(1, wanted[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        got[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(got[s] - wanted[s]) <= 2 * most[s], s
    assert abs(sum(got.values()) - sum(sizes.values())) <= 60
    assert sorted(map(str, out)) == sorted(map(str, op6(df.repartition(7)).collect()))


def test_entries_follow_virtual_time(spark):
    df, _ = documents(spark)
    from treeloom.llm.packing import words

    sized = df.select("doc_id", "source", words().alias("size"))
    by_ranges = [sorted((r["start"], r["doc_id"], r["pass"], r["taken"], r["finish"]) for r in mix(sized, rows_a_range=n).collect()) for n in (10**6, 40)]
    assert [x[:4] for x in by_ranges[0]] == [x[:4] for x in by_ranges[1]]
    at, last = 0, 0.0
    for start, _, _, taken, finish in by_ranges[0]:
        assert start == at and finish >= last
        at, last = at + taken, finish


def test_a_document_beyond_its_sources_target_blocks_no_other(spark):
    rows = [(0, "w " * 5000, "a")] + [(k, "w " * 10, "abc"[k % 3]) for k in range(1, 151)] + [(k, "w " * 10, "bc"[k % 2]) for k in range(200, 300)]
    out = op6(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = defaultdict(int)
    for r in out:
        got[r["source"]] += r["taken"]
    assert {r["source"]: r["target"] for r in out} == {"a": 1500.0, "b": 3000.0, "c": 3000.0} and dict(got) == {"a": 1500, "b": 3000, "c": 3000}
    assert all(r["taken"] == 0 for r in out if r["doc_id"] == 0)


def test_empty_and_wordless_tables(spark):
    df, _ = documents(spark)
    assert op6(df.where("false")).collect() == []
    out = op6(df.where("text IS NULL")).collect()
    assert out and all(r["taken"] == 0 and r["target"] == 0.0 for r in out)
    one = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in op6(one).collect()] == [(2.0, 2)]
    assert targets(one.selectExpr("source", "2L AS size")).first()["target"] == 2.0
