from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm.packing import op1, pack, pack_documents


def plain(sizes, lengths, overhead):
    """Best fit by looking at every bin and every remaining piece."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    bins, where, offset = [], {}, {}
    for at, i in enumerate(order):
        fits = [k for k, (cap, used) in enumerate(bins) if cap - used >= sizes[i]]
        if fits:
            k = min(fits, key=lambda k: (bins[k][0] - bins[k][1], k))
        else:

            def cost(c):
                room, total = c - sizes[i], sizes[i]
                for j in order[at + 1 :]:
                    if sizes[j] <= room:
                        room, total = room - sizes[j], total + sizes[j]
                return (c + overhead) / total

            k = len(bins)
            bins.append((min((c for c in sorted(lengths) if c >= sizes[i]), key=lambda c: (cost(c), c)), 0))
        where[i], offset[i] = k, bins[k][1]
        bins[k] = (bins[k][0], bins[k][1] + sizes[i])
    return [where[i] for i in range(len(sizes))], [offset[i] for i in range(len(sizes))], [min(c for c in lengths if c >= used) for _, used in bins]


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_pack_is_plain_best_fit(sizes, overhead):
    assert pack(sizes, (10, 20, 40), overhead) == plain(sizes, (10, 20, 40), overhead)


def check(rows, sizes, lengths):
    bins = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            bins[r["bin_id"]].append(r)
        else:
            assert r["bin_id"] is None
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in held:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert all(r["bin_tokens"] == at and r["bin_length"] == min(c for c in lengths if c >= at) for r in held)
    total = defaultdict(int)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    wanted = defaultdict(int)
    for i, n in sizes:
        wanted[i] += n or 0
    assert total == wanted


def test_documents_are_covered(spark):
    sizes = [(i, i * 7 % 93) for i in range(300)] + [(1000, None), (1001, 0), (1002, 500), (None, 30), (None, 30), (5, 35), (5, 35)]
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes], "doc_id long, n_tokens long, shard string")
    out = pack_documents(df, lengths=(16, 32, 64), overhead=4, pieces_a_shard=100).collect()
    check(out, sizes, (16, 32, 64))
    again = pack_documents(df.repartition(3), lengths=(16, 32, 64), overhead=4, pieces_a_shard=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    starts = sorted((r["piece"], r["start"], r["n_tokens"]) for r in out if r["doc_id"] == 1002)
    assert starts == [(k, 64 * k, 64) for k in range(7)] + [(7, 448, 52)]


def test_query_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b\tc", 9), (2, None, 9), (3, "", 9), (4, "w " * 9000, 9)], "doc_id long, text string, n_tokens long")
    check(op1(df).collect(), [(1, 3), (2, 0), (3, 0), (4, 9000)], (512, 1024, 2048, 4096, 8192))
    assert op1(df.where("false")).collect() == []
