import random
import re
import time
from html import unescape

from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.llm.html_text import BARE, NAMED, SHARE, TEXTUAL, THRESHOLD, main_text, op9, read

P = "This is a long sentence of the article, with commas, and a full stop. " * 4
Q = "Another paragraph follows here; it says something else, at some length. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></ul></nav>'


def test_article_without_surroundings():
    html = page(
        f'<header><h1>Site</h1></header>{MENU}<div class="ad">Buy now, really, now.</div><article><header><h1>Title &amp; more</h1></header><p>{P}<p>{Q}<br>tail <b>bold</b> &copy;'
        f'<form><label>Name</label><input></form><aside>Related: {P}</aside><div class="comment-list"><p>{P}</p></div><script>var x="</p>";</script></article><footer>&copy; x</footer>'
    )
    assert main_text(html) == f"Title & more\n\n{P.strip()}\n\n{Q.strip()} tail bold ©"


def test_page_without_article_element():
    html = page(f'<div id="top-menu"><a href="/">Home</a> <a href="/x">X</a></div><div class="wrap"><div class="content"><h2>Heading</h2><p>{P}</p><p>{Q}</p><p>Short.</p></div><div id="sidebar"><p>{Q}</p></div></div><div class="cookie-notice">We use cookies, sorry.</div>')
    assert main_text(html) == f"Heading\n\n{P.strip()}\n\n{Q.strip()}\n\nShort."


def test_edges():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text(page(MENU)) == ""
    assert main_text("just   text\n here &eacute;&#x41;&amp;") == "just text here éA&"
    assert main_text("<p>a < b <3 <!-- c --> d") == "a < b <3 d"
    assert main_text(page("<main><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>")) == "one\n\ntwo\n\na\n\nb"


def marked(html):
    """The text of the article element, by the markup of the given pages."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_driver_pages_match_their_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r for r in pages.collect()}
    out = op9(pages).collect()
    assert len(out) == len(html)
    for r in out:
        assert r["text"] == marked(html[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == html[r["page_id"]]["url"]
    # Scores of paths alone find nearly all articles.
    nameless = {k: re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)article>", r"<\1div>", r["html"])) for k, r in html.items()}
    assert all(main_text(x) == marked(html[k]["html"]) for k, x in nameless.items())
    tagless = {k: re.sub(r"<(/?)(?:nav|aside|footer|header|form)\b", r"<\1div", x) for k, x in nameless.items()}
    assert sum(main_text(x) == marked(html[k]["html"]) for k, x in tagless.items()) >= 0.98 * len(html)


def plain(tree):
    """The article by the same definitions, on a tree (tag, class, is it a link, children)."""
    blocks, elements = [], []

    def walk(node, path, around):
        tag, name, parts = node
        path, around = (*path, (tag, bool(name))), (*around, len(elements))
        elements.append((tag, around))
        for x in parts:
            if isinstance(x, str):
                blocks.append((x, path, around, False))
            elif x[0] == "a":
                elements.append(("a", (*around, len(elements))))
                blocks.append((x[2][0], path, (*around, len(elements) - 1), True))
            else:
                walk(x, path, around)

    walk(tree, (), ())
    paths = list(dict.fromkeys(p for _, p, _, _ in blocks))
    own = lambda p: [(t, link) for t, q, _, link in blocks if q == p]
    ratio = {p: (sum(len(t) for t, link in own(p) if not link) / len(own(p)), sum(len(re.findall("[.,;]", t)) for t, link in own(p) if not link) / len(own(p))) for p in paths}
    named = lambda p: sum(n for _, n in p)
    score = {}
    for p in paths:
        family = [q for q in paths if q[:-1] == p[:-1] and named(q) == named(p)]
        k = family.index(p)
        near = [ratio[q] for q in family[max(0, k - 1) : k + 2]]
        text, points = (sum(x) / len(near) for x in zip(*near))
        score[p] = (text * (1 + points)) ** 0.5 * NAMED ** named(p) * (1 if p[-1][0] in TEXTUAL else BARE)
    each = [(score[p], 0 if link else len(t)) for t, p, _, link in blocks]
    total = sum(s * n for s, n in each)
    usual = sum(s * s * n for s, n in each) / total if total else 0
    chosen = {p for p in paths if score[p] >= THRESHOLD * usual and any(q == p and not link for _, q, _, link in blocks)} or set(paths)
    weigh = lambda inside: sum(len(t) * min(1, score[p] / usual if usual else 1) for t, p, a, link in blocks if not link and p in chosen and inside(a, p))
    whole = weigh(lambda a, p: True)
    root = max((k for k in range(len(elements)) if weigh(lambda a, p: k in a) >= SHARE * whole), default=0) if whole else 0
    while root and elements[root][0] in TEXTUAL:
        root = elements[root][1][-2]
    while root:
        within = {p for _, p, a, _ in blocks if root in a and p in chosen and p[-1][0] in TEXTUAL}
        if all(root in a for _, p, a, _ in blocks if p in within):
            break
        root = elements[root][1][-2]
    inside = [b for b in blocks if root in b[2]]
    least = min((named(p) for _, p, _, _ in inside if p in chosen), default=0)
    return "\n\n".join(t for t, p, _, link in inside if p in chosen or not link and named(p) <= least)


def html_of(tree):
    tag, name, parts = tree
    return f"<{tag}{' class=' + name if name else ''}>{''.join(x if isinstance(x, str) else html_of(x) for x in parts)}</{tag}>"


def grown(rng, depth=0):
    """A random element; its text stands apart from other elements, so that it is a block."""
    tag = rng.choice(["div", "div", "section", "ul", "p", "p", "h2"]) if depth else "body"
    name = rng.choice(["", "", "ad", "site-menu", "own"]) if tag in ("div", "section") else ""
    sentence = lambda: ("word, " * rng.choice([1, 3, 10, 60])).strip() + "."
    if tag in ("p", "h2") or depth > 3:
        return (tag if depth <= 3 else "p", name if depth <= 3 else "", [sentence()])
    if tag == "ul":
        return (tag, "", [("li", "", [("a", "", [sentence()]) if rng.random() < 0.5 else sentence()]) for _ in range(rng.randint(1, 3))])
    parts = [grown(rng, depth + 1) for _ in range(rng.randint(1, 4))]
    return (tag, name, [sentence(), *parts] if rng.random() < 0.3 else parts)


def test_same_as_plain_definitions():
    rng = random.Random(5)
    nameless = lambda t: (t[0], "" if t[1] == "own" else t[1], [x if isinstance(x, str) else nameless(x) for x in t[2]])
    for _ in range(400):
        tree = grown(rng)
        assert main_text(html_of(tree)) == plain(nameless(tree))


def test_time_grows_with_length():
    began = time.time()
    for html in ("<a " * 1_000_000, "<div>" * 100_000, "<div>text" * 30_000, "<noscript>" * 100_000, "<b>" * 50_000 + "</i><h1>x" * 50_000, "<div>" * 50_000 + "</p>x" * 50_000, '<a href="' * 200_000, "<li><b>a" * 50_000, "<table>" + "<tr><td>a" * 50_000, "<!--" * 100_000):
        main_text(html)
    assert time.time() - began < 60


def test_what_authors_leave_out():
    article = f"<h1>Heading</h1><p>{P}<p>{Q}"
    wanted = f"Heading\n\n{P.strip()}\n\n{Q.strip()}"
    assert main_text(f"<html><head><title>T</title><body><article>{article}</article>") == wanted
    assert main_text(f"<title>T</title><meta charset=utf-8>{article}") == wanted
    svg = '<svg viewBox="0 0 1 1"><title>t</title><text>drawn</text></svg>'
    assert main_text(page(f"<article><p>{P}a {svg}b <button>Press</button>c. {Q}</p></article>")) == f"{P}a b c. {Q}".strip()
    for x in ('<p class="ad-free">{}</p>', '<p class="tags-explained">{}</p>', '<div class="notice-board-history">{}</div>', '<table class="widget"><tr><td>{}</table>'):
        assert main_text(page(f"<article>{article}{x.format('Words of the article.')}</article>")) == f"{wanted}\n\nWords of the article."
    for x in ('<div class="ad">{}</div>', '<section id="comments">{}</section>', '<div class="cookie-notice"><p>{}</div>', "<form>{}</form>", "<aside>{}</aside>"):
        assert main_text(page(f"<article>{article}{x.format('Words of no article.')}</article>")) == wanted


@given(st.text(st.sampled_from("<>/!-pdiv a=\"'&;lt\n"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup(html):
    assert all(b.text == b.text.strip() and b.text for b in read(html).blocks)
    main_text(html)


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", page(f"<p>{P}</p>"), "x"), (2, None, None, "x"), (None, "v", "", "x"), (4, "w", "<p>" + "word, " * 100_000, "x"), (1, "u", page(f"<p>{P}</p>"), "x")], "page_id long, url string, html string, text string")
    out = sorted((r["page_id"] or 0, r["n_chars"]) for r in op9(df).collect())
    assert out == [(0, 0), (1, len(P.strip())), (1, len(P.strip())), (2, 0), (4, len(("word, " * 100_000).strip()))]
    assert op9(df.where("false")).collect() == []


def test_wrappers_with_names_of_what_is_outside():
    article = f"<h1>Heading</h1><p>{P}</p><p>{Q}</p>"
    wanted = f"Heading\n\n{P.strip()}\n\n{Q.strip()}"
    for start, end in [("<form action=x>", "</form>"), *((f'<div class="{x}">', "</div>") for x in ("has-sidebar", "with-sidebar", "no-sidebar", "ad-free", "hidden-xs"))]:
        assert main_text(page(f"{start}{MENU}<div>{article}</div>{end}<footer>&copy; x</footer>")) == wanted
        assert main_text(page(f'{start}<article>{article}</article><div id="comments"><article>{Q}</article></div>{end}')) == wanted
    assert main_text(page(f'<div class="has-sidebar"><div>{article}</div><div class="sidebar"><p>{Q}</p></div></div>')) == wanted
    assert main_text(page(f'<div class="ad-free"><p>{P}</p></div><div class="ad-free"><p>{P}</p></div>')) == f"{P.strip()}\n\n{P.strip()}"
    assert main_text(page(f'<article>{article}</article><div id="comments"><article>{P * 3}</article></div>')) == wanted


def test_formulas_stay_in_their_paragraph():
    math = '<math xmlns="http://www.w3.org/1998/Math/MathML"><mi>a</mi><mo>=</mo><mn>2</mn></math>'
    assert main_text(page(f"<article><p>{P}Let {math} hold. {Q}</p></article>")) == f"{P}Let a=2 hold. {Q}".strip()
