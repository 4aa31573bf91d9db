import random

import corpus_pipeline as P
from treeloom.llm.shingle_sets import shingle_set
from treeloom.llm.simhash import fingerprint


def similarity(a, b):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / len(a | b)


def plain_kept(rows):
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    prints = [fingerprint(t) for _, t in rows]
    for k in range(len(rows)):
        for j in range(k):
            if (prints[k] ^ prints[j]).bit_count() <= 3 or similarity(rows[k][1], rows[j][1]) >= 0.8:
                a, b = top(k), top(j)
                root[max(a, b)] = min(a, b)
    return {rows[k][0] for k in range(len(rows)) if root[k] == k}


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in dict(P.STAGES)["simhash_near_dedup"](spark, df, "").collect())


def test_near_copies_match_brute_force(spark):
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = draw(90), []
    for g in range(12):
        base = draw(rng.randint(20, 260))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = draw(1)[0]
            copy = copy[: len(copy) - rng.randint(0, len(copy) // 12)]
            texts.append(" ".join(w + rng.choice(["", "", "\n"]) for w in copy))
            base = copy if g % 3 == 0 else base  # chains
    texts += [" ".join(passage + draw(30 + k)) for k in range(15)]
    rows = list(enumerate(texts))
    near = [(a, b) for a in range(len(rows)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    assert sum((fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() > 3 for a, b in near) > 10
    assert kept(spark, rows) == sorted(plain_kept(rows))


def test_sets():
    assert len(shingle_set(None)) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == len(shingle_set("a a a a a a a")) == 1
    assert shingle_set("A b\nc d  e f").tolist() == shingle_set("a B c d e F").tolist()
