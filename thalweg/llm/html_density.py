"""Main text of web pages by composite text density.

One regular expression cuts a page into tags, comments and text; a small tree
builder applies HTML's void, raw-text and implied-end rules. For every block node
the composite text density is computed from its characters C, tags T, link
characters LC and link tags LT (those of the body carry an index b):

    C/T * log(C/LC * T/LT) to the base ln(C/(C - LC) * LC + LCb/Cb * C + e)

with zeros in denominators taken as 1. A node's density sum is the sum of its
children's densities. The node of the largest sum is found; the smallest density
on its path from the body is the threshold; from the body down, each node at or
above the threshold gives its own largest-sum subtree, so text beside the first
one is found too. A subtree inside an article or main element that is itself at or above the
threshold stands for that element, so that headings and short paragraphs beside dense ones stay.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut before densities are taken, by element, role, and words
of class and id. Inline markup (b, i, a, span, br ...) belongs to its block: it
is no node and no tag, only its links are counted.

Results for the odd cases: null, empty and unparseable pages give an empty text
and 0 characters; a page with no element is its own text; every row, repeated
ones included, gives one row; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

# Fixed values of the HTML standard and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME_LEVEL = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}
CUT = frozenset("nav footer aside form script style noscript template svg math canvas iframe object embed audio video select button textarea dialog menu input head title noembed noframes".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
CONTAINERS = frozenset(("article", "main"))

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parts", "parent", "cut", "chars", "tags", "link_chars", "links", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.parts: list[Node | tuple[str, bool]] = []  # blocks, and text with whether it is in a link


def _is_cut(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CUT or tag == "header" and not in_article:
        return True
    if not attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in CUT_ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html") and tag not in CONTAINERS and not CUT_WORDS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def parse(html: str) -> Node:
    """Tree of block nodes; the root is the body, whether or not the page has that tag."""
    root = Node("body", None, False)
    here, open_tags, links, at = root, [], 0, 0  # open_tags: (tag, block or None)
    opened: Counter[str] = Counter()  # how many of each are open, so that most searches end before they start
    size, last = len(html), html.rfind(">") + 1  # no tag ends after the last >

    def text(piece: str) -> None:
        if piece and not here.cut:
            here.parts.append((piece, links > 0))

    def close(k: int) -> None:
        nonlocal here, links
        for tag, block in reversed(open_tags[k:]):
            opened[tag] -= 1
            if block is not None:
                here = block.parent
            elif tag == "a":
                links -= 1
        del open_tags[k:]

    def find(tags: frozenset | set, until: frozenset | set) -> int:
        """The outermost open one of tags above the nearest open one of until."""
        found, left = -1, sum(opened[t] for t in tags)
        for k in range(len(open_tags) - 1, -1, -1):
            if not left or open_tags[k][0] in until:
                break
            if open_tags[k][0] in tags:
                found, left = k, left - 1
        return found

    limits = {"table", "td", "th", "caption", "button", "object"}
    while at < size:
        m = TOKEN.search(html, at, last) if at < last else None
        if m is None:
            text(unescape(html[at:].split("<!--")[0]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        if at == last and m[0].startswith(("<!--", "<![CDATA[")) and not m[0].endswith(("-->", "--!>", "]]>")):
            at = size  # a comment that nothing ends holds the rest
        if m[1] is not None:
            text(m[1])
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "br":
                text(" ")
                continue
            k = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), -1) if opened[tag] else -1
            if k >= 0:
                close(k)
            continue
        if tag == "body" or tag == "html":
            continue
        if tag == "head":
            open_tags.append((tag, here := Node(tag, here, True)))
            opened[tag] += 1
            continue
        if tag in CLOSES_P and (k := find({"p"}, limits)) >= 0:
            close(k)
        if tag in SAME_LEVEL and (k := find(*SAME_LEVEL[tag])) >= 0:
            close(k)
        if tag == "a" and (k := find({"a"}, limits)) >= 0:
            close(k)
        if tag not in RAW and open_tags and open_tags[0][0] == "head" and tag not in CUT and tag not in VOID:
            close(0)  # what belongs to the body ends a head left open
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag == "br" or tag == "wbr":
                text(" " if tag == "br" else "")
            elif tag not in VOID:
                cut = bool(m[4]) and _is_cut(tag, m[4], True)
                if cut and tag != "a":
                    node = Node(tag, here, True)
                    open_tags.append((tag, node))
                    here = node
                else:
                    open_tags.append((tag, None))
                    links += tag == "a"
                opened[tag] += 1
            continue
        if tag in VOID:
            text(" ")
            continue
        cut = here.cut or _is_cut(tag, m[4], any(opened[t] for t in CONTAINERS))
        node = Node(tag, here, cut)
        if not cut:
            here.parts.append(node)
        if not m[4].rstrip().endswith("/"):
            here = node
            open_tags.append((tag, node))
            opened[tag] += 1
    return root


def measure(root: Node) -> Node:
    """Fills densities; returns the node of the largest density sum."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node))
    for node in reversed(order):
        chars = link_chars = links = tags = 0
        was = False
        for p in node.parts:
            if isinstance(p, Node):
                chars, tags, link_chars, links = chars + p.chars, tags + p.tags + 1, link_chars + p.link_chars, links + p.links
                was = False
            else:
                n = len(p[0]) - p[0].count(" ") - p[0].count("\n")
                chars += n
                if p[1]:
                    link_chars += n
                    links += not was
                was = p[1]
        node.chars, node.tags, node.link_chars, node.links = chars, tags, link_chars, links
    share = root.link_chars / max(root.chars, 1)
    best = root
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.links
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base
        else:
            node.density = 0.0
        inner = [p for p in node.parts if isinstance(p, Node)]
        node.total = sum(p.density for p in inner) or node.density
        node.best = max((p.best for p in inner), key=lambda x: x.total, default=node)
        if node.total >= node.best.total:
            node.best = node
        if node is root:
            best = node.best
    return best


def chosen(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    top = measure(root)
    if not top.chars:
        return [root]
    path, node = [top.density], top
    while node is not None:
        path.append(node.density)
        node = node.parent
    threshold = min((x for x in path if x > 0), default=0.0)

    outer: dict[int, Node] = {}  # of each node the outermost article or main at or above the threshold that holds it
    stack = [root]
    while stack:
        node = stack.pop()
        over = outer.get(id(node.parent)) or (node if node.tag in CONTAINERS and node.density >= threshold else None)
        if over is not None:
            outer[id(node)] = over
        stack.extend(p for p in node.parts if isinstance(p, Node))

    found: list[Node] = []
    marked: set[int] = set()
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) in marked or node.density < threshold:
            continue
        pick = outer.get(id(node.best), node.best)
        if pick.chars and id(pick) not in marked:
            found.append(pick)
            inner = [pick]
            while inner:
                x = inner.pop()
                marked.add(id(x))
                inner.extend(p for p in x.parts if isinstance(p, Node))
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    keep = {id(x) for x in found}
    out, stack = [], [root]
    while stack:  # page order; a subtree inside another is already in it
        node = stack.pop()
        if id(node) in keep:
            out.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (text := SPACE.sub(" ", "".join(run)).strip()):
            out.append(text)
        run.clear()

    stack: list[Node | tuple[str, bool] | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, Node):
            flush()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            run.append(x[0])
    flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of a page."""
    if not html:
        return ""
    return " ".join(t for node in chosen(parse(html)) for t in blocks(node))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, html_col):
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(id_col, url_col, html_col)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
