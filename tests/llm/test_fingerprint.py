import hashlib
import math
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm.fingerprint import FILTER_FEATURES, LEAST_STEP, POPULAR, STEPS, WINDOW, decoded, features, filters, likeness, op8, rarity, steps


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_entropy_of_each_window(data):
    found = steps(np.frombuffer(data, np.uint8)).tolist()
    assert len(found) == max(0, len(data) - 63)
    for i, step in enumerate(found):
        entropy = -sum(c / 64 * math.log2(c / 64) for c in Counter(data[i : i + 64]).values())
        assert abs(step - entropy / 6 * STEPS) <= 1.01


def plain_features(data, rank):
    """Hashes are not rebuilt here: the windows themselves, in order, once each."""
    if not data:
        return []
    data = data.ljust(WINDOW, b"\0")
    r = rank[steps(np.frombuffer(data, np.uint8))].tolist()
    votes = Counter(min(range(p, p + WINDOW), key=lambda i: (r[i], i)) for p in range(len(r) - WINDOW + 1))
    found = sorted(i for i, n in votes.items() if n >= POPULAR and r[i] <= STEPS - LEAST_STEP) or [min(range(len(r)), key=lambda i: (r[i], i))]
    return list(dict.fromkeys(data[i : i + WINDOW] for i in found))


def texts(n=30):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 8, 20, 200]))).encode() for _ in range(n)] + [b"z" * 900, b"ab" * 64, b"q" * 63]


def test_features_alone_and_together():
    rank = np.random.default_rng(1).permutation(STEPS + 1)
    some = texts()
    who, h = features(some, rank)
    for k, data in enumerate(some):
        alone = features([data], rank)[1]
        assert h[who == k].tolist() == alone.tolist()
        assert len(alone) == len(plain_features(data, rank))
    chains = filters(some, rank)
    assert [len(x) for x in chains] == [-(-np.count_nonzero(who == k) // FILTER_FEATURES) for k in range(len(some))]


def test_likeness():
    rank = np.arange(STEPS + 1)
    rng = random.Random(4)
    long = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=40_000)).encode() for _ in range(2)]
    a, b, half, none = filters([long[0], long[1], long[0][:20_000] + long[1][:20_000], b""], rank)
    assert likeness(a, a) == 1.0 and likeness(none, none) == 1.0 and likeness(a, none) == 0.0
    assert likeness(a, b) < 0.2 < 0.4 < likeness(a, half) < 0.8
    assert likeness(a, half) == likeness(half, a)


def test_documents(spark):
    some = [x.decode() for x in texts(60)]
    rows = [(3 * i + 1, t, "x") for i, t in enumerate(some)] + [(2, None, "x"), (5, "", "x"), (8, "é" * 5000, "x"), (11, some[0], "x"), (None, "null id", "x"), (4, some[1], "x"), (4, "another", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(3)
    out = op8(df).collect()
    assert len(out) == len(rows)
    order = sorted(((-1 if i is None else i), t or "") for i, t, _ in rows)
    wanted = []
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        n = len(t) // 2
        wanted.append((i, hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    rank = rarity(df)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["edited_sha256"]) for r in out) == sorted(wanted)
    prints = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints[r["doc_id"]] = r["fingerprint"]
        assert likeness(decoded(r["fingerprint"]), decoded(r["edited_fingerprint"])) == r["near_edited"]
    assert prints[11] == prints[1] and prints[2] == prints[5] == ""
    assert decoded(prints[8]).tolist() == filters([("é" * 5000).encode()], rank)[0].tolist()
    assert op8(df.where("false")).collect() == []
    assert len(op8(df.where("doc_id = 8")).collect()) == 1
