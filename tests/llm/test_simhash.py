import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm import simhash
from treeloom.llm.components import components
from treeloom.llm.simhash import anchors, fingerprint, linked_components, links, op10


def plain_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(st.sampled_from("aBÀÉ \t\n  x"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_anchors_cover_all_near_pairs():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        index, keys, homes = anchors(np.array([x, y], np.uint64))
        home = set(keys[(index == 0) & homes].tolist())
        assert home & set(keys[index == 1].tolist())
        assert len(set(zip(index.tolist(), keys.tolist()))) == len(index) <= 2 * 34


def plain_components(rows):
    out = {}
    fps = sorted({f for _, f in rows})
    group = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[:i]:
                if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    for f in fps:
        ids = [i for i, g in rows if group[g] == group[f] and i is not None]
        out[f] = min(ids) if ids else None
    return out


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            rows.append((rng.randint(0, 5000), x))
    rows += [(None, rows[0][1]), (None, 12345), (7, 0), (8, 1 << 63), rows[3], rows[3]]
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in rows]
    out = linked_components(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    wanted = plain_components(rows)
    assert len(out) == len(rows)
    assert all(r["component_id"] == wanted[r["fp"] % (1 << 64)] for r in out)


def test_large_group_spans_with_few_links(spark):
    base = random.Random(1).getrandbits(64)
    fps = {base} | {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = links(df).distinct()
    assert found.count() < 40 * len(fps)
    assert components(found).select("root").distinct().count() == 1
    assert components(found).count() == len(fps)


def test_many_fingerprints_of_one_anchor():
    """Those of one anchor are divided by bytes of the other half; no link is lost."""
    rng = random.Random(8)
    for side in (0, 1):
        half = rng.getrandbits(32)
        words = [rng.getrandbits(32) for _ in range(2000)]
        words += [w ^ sum(1 << b for b in rng.sample(range(32), rng.randint(1, 3))) for w in words] + [rng.getrandbits(32) for _ in range(1000)]
        fps = np.unique(np.array([half << 32 | w if side else w << 32 | half for w in words], np.uint64))
        groups = list(simhash._divided(side << 32, fps))
        assert len(groups) > 100
        near = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1}
        place = {x: k for k, x in enumerate(fps.tolist())}
        found = set()
        for g in groups:
            for i in range(len(g)):
                found |= {tuple(sorted((place[int(g[i])], place[int(g[j])]))) for j in np.flatnonzero(np.bitwise_count(g[i + 1 :] ^ g[i]) <= 3) + i + 1}
        assert found == near and len(near) >= 2000


def test_hubs(spark):
    edges = [(k, 0) for k in range(1, 3000)] + [(5000 + k, 3) for k in range(1500)] + [(9000, 8000)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len(out) == 3000 + 1500 + 2 and set(out.values()) == {0, 8000} and out[9000] == 8000


def test_documents_and_edges(spark):
    rows = [(1, "one two three four five"), (2, "One two\tthree four  five"), (3, None), (4, ""), (5, " \n"), (6, "w " * 50_000), (7, "one two three four five"), (7, "one two three four five"), (9, "quite another text about nothing at all")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    out = {r["doc_id"]: r for r in op10(df).collect()}
    assert op10(df).count() == len(rows)
    for i, t in rows:
        assert out[i]["fingerprint"] == f"{plain_fingerprint(t):016x}"
    assert [out[i]["component_id"] for i in (1, 2, 3, 4, 5, 7, 9)] == [1, 1, 3, 3, 3, 1, 9]
    assert op10(df.where("false")).collect() == []
