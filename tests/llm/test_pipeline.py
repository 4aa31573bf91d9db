import random
from collections import Counter, defaultdict

import corpus_pipeline
from treeloom.llm import pipeline as P
from treeloom.llm.common import checkpointed, table
from treeloom.llm.simhash import fingerprint


def stages(spark, docs, sf_dir):
    out = [checkpointed(docs)]
    for name, stage in P.STAGES:
        out.append(checkpointed(stage(spark, out[-1], sf_dir)))
    return out


def plain_line_dedup(rows):
    index, out = defaultdict(list), {}
    for i, text in sorted(rows.items()):
        kept, lines = [], text.split("\n")
        for line in lines:
            words = frozenset(line.encode().split())
            near = {s for w in words for s in index[w]}
            if not any(5 * len(words & s) >= 4 * len(words | s) for s in near):
                kept.append(line)
            for w in words:
                index[w].append(words)
        if len(kept) == len(lines) or any(x.split() for x in kept):
            out[i] = "\n".join(kept)
    return out


def plain_groups(rows):
    ids = sorted(rows)
    prints = [fingerprint(rows[i]) for i in ids]
    root = list(range(len(ids)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(ids)):
        for j in range(k):
            if (prints[k] ^ prints[j]).bit_count() <= 3 and top(k) != top(j):
                root[max(top(k), top(j))] = min(top(k), top(j))
    return {ids[k] for k in range(len(ids)) if root[k] == k}


def test_entry_names_the_stages():
    assert corpus_pipeline.STAGES is P.STAGES and corpus_pipeline.run is P.run and [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "best_fit_packing"]


def test_stages_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    raw, told, lined, alone, mixed, packed = stages(spark, docs, "/root/testdata/sf0.001")
    assert [x.columns for x in (told, lined, alone, mixed)] == [docs.columns] * 4
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    assert told.count() >= 0.97 * raw.count()
    assert texts(lined) == plain_line_dedup(texts(told))
    assert all(r["n_chars"] == len(r["text"]) for r in lined.collect() if r["text"] != texts(told)[r["doc_id"]])
    assert set(texts(alone)) == plain_groups(texts(lined)) and alone.count() == len(texts(alone))
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 3 and set(times) <= set(texts(alone))
    sizes = {i: len(t.encode().split()) for i, t in texts(alone).items()}
    assert abs(sum(sizes[i] * n for i, n in times.items()) - sum(sizes.values())) <= max(sizes.values())
    total = defaultdict(int)
    for r in packed.collect():
        total[r["doc_id"]] += r["n_tokens"]
    assert dict(total) == {i: n * sizes[i] for i, n in times.items()}


def test_edges(spark):
    rows = [(1, None, "en", "a", None, 1), (2, "", "en", "a", 0, 1), (3, "The same words of a text.", None, None, 25, 1), (3, "The same words of a text.", None, None, 25, 1), (None, "Other words, of another text here.", "en", "b", 3, 1), (5, "1 2 3", "de", "b", 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    out = stages(spark, df, "")
    assert [x.columns for x in out[:-1]] == [df.columns] * 5
    assert {r["doc_id"] for r in out[1].collect()} <= {3, None}
    assert [x.count() for x in stages(spark, df.where("false"), "")] == [0] * 6
    stage = dict(P.STAGES)
    again = stage["simhash_near_dedup"](spark, df, "")
    assert sorted(str(r["doc_id"]) for r in again.collect()) == ["1", "3", "5", "None"]
    assert stage["mix_sources"](spark, df, "").count() >= 1


def test_null_and_repeated_ids_of_unrelated_texts(spark):
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "blue", "green", "grey"))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (12, d), (13, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r["doc_id"], r["text"]) for r in dict(P.STAGES)["simhash_near_dedup"](spark, df, "").collect()]
    assert sorted(out, key=str) == sorted([(None, a), (None, b), (5, c), (5, d)], key=str)


def test_null_repeated_and_equal_rows_through_every_stage(spark):
    english = "the river went along with them and so did all of those who have been there before us"
    texts = [" ".join(random.Random(k).choices(english.split(), k=12)) + f" number{k} word{k} thing{k}" for k in range(12)]
    rows = [(None, t, "en", "a", None) for t in texts[:4]] + [(5, t, "en", None, 7) for t in texts[4:8]] + [(9, texts[8], "en", "b", 1)] * 3 + [(10 + k, t, "en", "b", 1) for k, t in enumerate(texts[9:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _, told, lined, alone, mixed, packed = (x.collect() for x in stages(spark, df, ""))
    assert len(told) == len(rows)
    # Rows of one id and text are one document, and keep the same lines.
    assert Counter((r["doc_id"], r["text"]) for r in lined) == Counter((i, t) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["text"]) for r in alone) == Counter({(i, t) for i, t, *_ in rows})
    assert {r["text"] for r in mixed} <= set(texts) and sum(len(r["text"].split()) for r in mixed) >= 0.8 * sum(len(r["text"].split()) for r in alone)
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].split()) for r in mixed)


def test_columns_that_are_null_tell_rows_apart(spark):
    rows = [(1, "some text of words", "x", None), (1, "some text of words", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert df.select(P._whole(df).alias("w")).distinct().count() == 2
