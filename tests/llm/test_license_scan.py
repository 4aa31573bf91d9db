import math
import random
import re

from treeloom.llm.license_scan import MATCH, OTHER, Scanner, op7, scan
from treeloom.llm.license_texts import TEMPLATES

SCANNER = Scanner(TEMPLATES)


def weights_of():
    words = {k: re.findall(r"\w+", t.lower()) for k, t in TEMPLATES.items()}
    often = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    return {k: [math.log(1 + len(words) / often[w]) ** 2 for w in x] for k, x in words.items()}


WEIGHTS = weights_of()


def plain(text, name):
    """Score, weighted coverage and span of the best local alignment over the whole text."""
    a, b, weights = re.findall(r"\w+", TEMPLATES[name].lower()), re.findall(r"\w+", text.lower()), WEIGHTS[name]
    rows = [[(0, -1, 0.0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0.0, -1, -1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s, f, m = rows[i - 1][j - 1]
            cell = (s + MATCH, j - 1 if f < 0 else f, m + weights[i - 1]) if a[i - 1] == b[j - 1] else (s + OTHER, f, m)
            for s, f, m in (rows[i - 1][j], rows[i][j - 1]):
                if s + OTHER > cell[0]:
                    cell = (s + OTHER, f, m)
            rows[i][j] = cell if cell[0] > 0 else (0, -1, 0.0)
            if cell[0] > best[0]:
                best = (cell[0], cell[2] / sum(weights), cell[1], j - 1)
    return best


def degraded(rng, words, part):
    """The words with about that part of them replaced, left out or doubled."""
    out = []
    for w in words:
        kind = rng.random() / part
        out += [w] if kind > 1 else rng.choice([["typo"], [], [w, "extra"]])
    return out


def test_same_as_whole_alignment():
    rng = random.Random(9)
    filler = ["lorem", "the", "of", "software", "and", "ipsum", "this", "dolor", "to", "is"]
    for k in range(40):
        words = TEMPLATES[rng.choice(list(TEMPLATES))].split()
        if k % 2 and len(words) > 20:
            words = degraded(rng, words, 0.04)
        text = " ".join(rng.choices(filler, k=rng.randint(0, 60)) + words + rng.choices(filler, k=rng.randint(0, 60)))
        spans = [m.span() for m in re.finditer(r"\w+", text)]
        wanted = []
        for score, coverage, first, last, name in sorted(((*plain(text, x), x) for x in TEMPLATES), key=lambda x: (-x[0], -x[1])):
            if coverage >= 0.75 and all(last < a or b < first for a, b, _, _ in wanted):
                wanted.append((first, last, name, coverage))
        found = SCANNER.scan(text)
        assert [(m.license, m.start, m.end) for m in found] == [(x, spans[a][0], spans[b][1]) for a, b, x, _ in sorted(wanted)], text
        assert all(abs(m.coverage - c) < 1e-5 for m, (_, _, _, c) in zip(found, sorted(wanted)))


def test_degraded_templates_are_found():
    """Of templates with a tenth to a fifth of their words changed; the name may be that of
    a template which differs by a clause."""
    rng = random.Random(4)
    long = [k for k, t in TEMPLATES.items() if len(t.split()) > 40]
    filler = ["lorem", "ipsum", "dolor", "amet"]
    hits = exact = 0
    for k in range(120):
        name = long[k % len(long)]
        text = " ".join(rng.choices(filler, k=30) + degraded(rng, TEMPLATES[name].split(), rng.uniform(0.1, 0.2)) + rng.choices(filler, k=30))
        names = [m.license for m in SCANNER.scan(text)]
        hits, exact = hits + bool(names), exact + (names == [name])
    assert hits >= 0.95 * 120 and exact >= 0.9 * 120, (hits, exact)


def test_inserted_clauses_hide_nothing():
    for name in ("MIT", "BSD-3-Clause", "Zlib", "Unlicense"):
        words = TEMPLATES[name].split()
        middle = len(words) // 2
        for n in (33, len(words) // 2):
            text = " ".join(["lorem"] * 20 + words[:middle] + ["ipsum"] * n + words[middle:] + ["dolor"] * 20)
            (found,) = SCANNER.scan(text)
            assert found.license == name and found.coverage > 0.95 and text[found.start : found.end].startswith(words[0].strip('"')) and found.end > text.index("dolor") - 30


def test_names_decide_notices():
    for name in (x for x in TEMPLATES if x.startswith("notice:")):
        assert [m.license for m in SCANNER.scan(f"Copyright by us. {TEMPLATES[name]} See there.")] == [name]
    assert [m.license for m in SCANNER.scan("Licensed under the Apache License Version 2.0")] == ["notice:Apache-2.0"]
    assert not SCANNER.scan("Licensed under the Foo License.") and not SCANNER.scan("Licensed under the Foo License, Version 2.0.") and not SCANNER.scan("Released under the terms of the contract.")


def test_clean_texts_have_no_match():
    rng = random.Random(1)
    words = [w for t in TEMPLATES.values() for w in t.split()]
    assert not SCANNER.scan(" ".join(rng.choices(words, k=5000)))
    assert not SCANNER.scan("a licence is a permission to use software under conditions")


def test_twice_and_lines_of_the_driver(spark):
    notice = "Licensed under CC BY-NC 4.0."
    out = SCANNER.scan(f"x {notice} {'word ' * 40} {notice}")
    assert [m.license for m in out] == ["notice:CC-BY-NC-4.0"] * 2
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    lines = ["This work is licensed under the GNU General Public License, version 3.", notice, "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    rows = op7(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_matches"] > 0) == any(x in texts[r["doc_id"]] for x in lines), r


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x " * 100_000 + TEMPLATES["MIT"] + " y" * 100_000, 0), (None, "Released under the MIT License", 0), (3, "Released under the MIT License", 0)], "doc_id long, text string, coverage int")
    out = sorted(((r["doc_id"] or 0), r["n_matches"], r["licenses"]) for r in op7(df).collect())
    assert [x[:2] for x in out[:1] + out[1:3]] == [(0, out[0][1]), (1, 0), (2, 0)] and "notice:MIT" in out[0][2]
    assert any(i == 3 and "MIT" in n.split(";") for i, _, n in out)
    assert op7(df.where("false")).collect() == []
    assert all(not r["matches"] for r in scan(df, {}).collect())
