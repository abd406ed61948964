import math
import random
import time

from thalweg.llm import html_density
from thalweg.llm.html_density import Node, chosen, extract_pages, main_text, measure, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 para&shy;graph with enough words to stand out from all the rest.<p>Second&nbsp;one, also with a number of words in it.<br>After the break.</article>
<section class="comments"><p>Nice post, thank you very much for writing it down.</p></section><aside>Side</aside><form><input>Name</form><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "Head & line First bold para\xadgraph with enough words to stand out from all the rest. Second one, also with a number of words in it. After the break."


def test_densest_block_without_an_article():
    links = "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(30))
    text = "".join(f"<p>Paragraph {i} has a fair number of words, so that it is dense.</p>" for i in range(4))
    got = main_text(f"<html><body><div><ul>{links}</ul></div><div>{text}</div></body></html>")
    assert got.startswith("Paragraph 0") and got.endswith("so that it is dense.") and "link number" not in got


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain", "<p>a<p>b", "<", "<div", "<!-- x", "<script>", "<a href=x>l</a>", "</p></div>x", "<table><tr><td>a<td>b</table>", "<div>" * 3000 + "deep" + "</div>" * 3000]
    rows = [(i, None if i == 3 else f"u{i}", h) for i, h in enumerate(odd)] + [(None, None, None), (4, "u4", "<p>a<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.url): r for r in extract_pages(pages).collect()}
    assert extract_pages(pages).count() == len(rows)
    assert got[0, "u0"].text == "" and got[0, "u0"].n_chars == 0 and got[4, "u4"].text == "a b" and got[11, "u11"].text == "a b" and got[12, "u12"].text == "deep"
    assert extract_pages(pages.limit(0)).count() == 0


def slow_density(node, share):
    """(characters, tags, link characters, links, density, sum of the children's densities) by plain recursion."""
    c = t = lc = lt = 0
    total, was = 0.0, False
    for p in node.parts:
        if isinstance(p, Node):
            got = slow_density(p, share)
            c, t, lc, lt, total = c + got[0], t + got[1] + 1, lc + got[2], lt + got[3], total + got[4]
            was = False
        else:
            n = len(p[0].replace(" ", "").replace("\n", ""))
            c, lc, lt = c + n, lc + n * p[1], lt + (p[1] and not was)
            was = p[1]
    d = 0.0
    if c:
        d = c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c, t, lc, lt, d, total or d


def random_page(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if depth < 5 and kind < 0.5:
            out.append(f"<div>{random_page(r, depth + 1)}</div>")
        elif kind < 0.7:
            out.append(f"<a href=x>{'link ' * r.randint(1, 4)}</a>")
        else:
            out.append("<p>" + "word " * r.randint(1, 30) + "</p>")
    return "".join(out)


def test_densities_against_brute_force():
    for seed in range(60):
        root = parse(f"<body>{random_page(random.Random(seed))}</body>")
        best = measure(root)
        share = root.link_chars / max(root.chars, 1)
        nodes, stack = [], [root]
        while stack:
            x = stack.pop()
            nodes.append(x)
            stack.extend(p for p in x.parts if isinstance(p, Node))
        for x in nodes:
            c, t, lc, lt, d, total = slow_density(x, share)
            assert (x.chars, x.link_chars, x.links) == (c, lc, lt) and abs(x.density - d) < 1e-9 and abs(x.total - total) < 1e-9
        assert abs(best.total - max(x.total for x in nodes)) < 1e-9
        assert chosen(root)


def test_density_decides(monkeypatch):
    """With every density alike the menu of links is no longer told from the text."""
    links = "".join(f'<li><a href="/{i}">link number {i}</a></li>' for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div>{'<p>Some words that make a dense paragraph.</p>' * 4}</div></body>"
    assert "link number" not in main_text(page)
    right = html_density.measure

    def flat(root):
        right(root)
        stack = [root]
        while stack:
            x = stack.pop()
            x.density, x.total, x.best = 1.0, 1.0, x
            stack.extend(p for p in x.parts if isinstance(p, Node))
        return root

    monkeypatch.setattr(html_density, "measure", flat)
    assert "link number" in main_text(page)


def test_broken_pages_take_linear_time():
    start = time.perf_counter()
    for page in ("<a " * 40_000, '<a "' * 20_000 + ">", "<div>" * 20_000 + "<p>x" * 20_000, "</b>" * 40_000, "<!--" * 40_000, "<td>" * 20_000):
        main_text(page)
    assert time.perf_counter() - start < 20
