"""Main text of pages by composite text density.

A page is read once into a tree.  What is never article text (scripts, styles, forms,
menus, headers, footers, asides, and elements whose class or id names adverts, notices,
comments and the like) is left out.  Every node gets its composite text density: characters
for each tag, less what links hold, adjusted by the page's share of linked text.  The node
whose children's densities sum to the most holds the article; the least density on its path
to the body is the threshold that a subtree beside it must reach to belong to the article
as well.  An <article> around that node, or a <main> around it that has no other articles, is
taken whole; one that does not hold it has no say.  Blocks come out in page order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# Fixed values of HTML: elements without content, with raw text, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search"
    " section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br button caption legend option select body html head tbody td tfoot th thead tr".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
WALLS = frozenset("ul ol dl table select menu".split())

# What is no article text, by element and by words of class, id or role.
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas math audio video form button input select"
    " textarea label nav header footer aside menu dialog search noembed noframes xmp".split()
)
NOISE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices"
    " pagination popup promo promoted promotion related reply replies respond sidebar share sharing social sponsor"
    " sponsored subscribe subscription toolbar widget complementary contentinfo search alert".split()
)
ARTICLE = frozenset("article main".split())


class Node:
    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "parent", "parts", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.parts = tag, parent, [], []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _noise(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether class, id or role names noise; ``has-sidebar`` and the like name a frame around it."""
    if tag in ("body", "html", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name in ("class", "id", "role"):
            found = set(_WORD.findall(value)) - ({"header"} if in_article else set())
            if not NOISE.isdisjoint(found) and found.isdisjoint(("has", "with", "no", "without")):
                return True
    return False


def parse(html: str) -> Node:
    """Tree of what may be article text; ``parts`` of a node are its texts and children in order."""
    root = Node("html", None)
    here, at, skip = root, 0, []  # skip: open elements inside one that is left out
    open_count: dict[str, int] = {}

    def close(to: Node) -> None:
        nonlocal here
        while here is not to:
            open_count[here.tag] -= 1
            here = here.parent
        open_count[here.tag] -= 1
        here = here.parent

    def add(text: str) -> None:
        if text and not skip:
            here.parts.append(unescape(text) if "&" in text else text)

    while at < len(html):
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at, name = m.end(), m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if skip:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
            elif open_count.get(tag):
                node = here
                while node.tag != tag:
                    node = node.parent
                if not (tag not in BLOCK and _crosses(here, node)):
                    close(node)
            elif tag == "br":
                here.parts.append(Node("br", here))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if skip:
            if tag not in VOID and not m[3].endswith("/"):
                if tag in SIBLINGS:
                    while skip and len(skip) > 1 and skip[-1] in SIBLINGS[tag] | {"p"}:
                        skip.pop()
                elif tag in CLOSES_P and len(skip) > 1 and skip[-1] == "p":
                    skip.pop()
                skip.append(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P and open_count.get("p"):
            node = here
            while node.tag != "p":
                node = node.parent
            close(node)
        if tag in SIBLINGS:
            node, last = here, None
            while node is not root and node.tag not in WALLS:
                if node.tag in SIBLINGS[tag]:
                    last = node
                node = node.parent
            if last:
                close(last)
        in_article = any(open_count.get(x) for x in ARTICLE)
        if (tag in NEVER and not (tag == "header" and in_article)) or _noise(tag, m[3], in_article):
            if tag not in VOID and not m[3].endswith("/"):
                skip.append(tag)
            continue
        node = Node(tag, here)
        here.parts.append(node)
        here.children.append(node)
        if tag not in VOID:
            here = node
            open_count[tag] = open_count.get(tag, 0) + 1
    return root


def _crosses(here: Node, node: Node) -> bool:
    """Whether closing an inline element would also close a block opened inside it."""
    while here is not node:
        if here.tag in BLOCK and here.tag != "p":
            return True
        here = here.parent
    return False


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def measure(root: Node) -> list[Node]:
    """Set the composite text density of every node; the nodes, parents first."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub("", p)) for p in node.parts if isinstance(p, str))
        node.chars = own + sum(c.chars for c in node.children)
        node.tags = sum(c.tags + 1 for c in node.children)
        linked = node.tag == "a"
        node.link_chars = node.chars if linked else sum(c.link_chars for c in node.children)
        node.link_tags = node.tags + 1 if linked else sum(c.link_tags for c in node.children)
    whole = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if not c:
            continue
        rest = max(1, c - lc)
        base = math.log(max(math.e, c / rest * lc + whole * c + math.e))
        node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt) + 1e-9, max(base, 1.0001))
    return nodes


def article(root: Node) -> list[Node]:
    """Subtrees that hold the article, in page order."""
    nodes = measure(root)
    sums = {id(n): sum(c.density for c in n.children) for n in nodes}
    best = max(nodes, key=lambda n: sums[id(n)])
    if not sums[id(best)]:
        return [root]
    path, node = [best.density], best.parent
    while node is not None:
        path.append(node.density)
        node = node.parent
    threshold = min(path)
    top = _named(best, nodes)
    if top.parent is None:
        return [top]
    return [n for n in top.parent.children if n is top or (n.density >= threshold and n.chars and n.link_chars * 2 < n.chars)]


def _named(best: Node, nodes: list[Node]) -> Node:
    """The outermost <article> around the densest node, or else a <main> around it without other articles, or else the node."""
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    articles = [n for n in path if n.tag == "article"]
    if articles:
        return articles[-1]
    inside = {id(best)}
    for n in nodes:
        if n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
    held = set()
    for n in nodes:
        if n.tag == "article" and n.chars and id(n) not in inside:
            while n is not None and id(n) not in held:
                held.add(id(n))
                n = n.parent
    return next((n for n in reversed(path) if n.tag == "main" and id(n) not in held), best)


def blocks_of(node: Node, out: list[str]) -> None:
    """Blocks of text under a node in page order, white space made one blank, without recursion."""
    line: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    todo: list = [(node, False)]
    while todo:
        part, done = todo.pop()
        if isinstance(part, str):
            line.append(part)
            continue
        if part.tag in BLOCK:
            end()
        if not done and part.tag != "br":
            todo.append((part, True)) if part.tag in BLOCK else None
            todo.extend((p, False) for p in reversed(part.parts))
    end()


def main_text(html: str) -> str:
    out: list[str] = []
    for node in article(parse(html)):
        blocks_of(node, out)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        yield pd.Series([main_text(x) for x in part], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each page.

    A null page counts as empty and gives an empty text; broken markup is read as far as it
    goes; a very long page is parsed whole, in its own row; of equal density sums the first
    subtree in page order wins; repeated rows and null ids are kept as they come; other columns are not
    read; an empty table gives no rows.
    """
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", _text(F.coalesce(F.col("html"), F.lit(""))).alias("text")
    ).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
