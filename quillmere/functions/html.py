"""HTML to a flat node list, so that extraction itself is column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import spread_small
from .fields import WHITESPACE, strip

PAGE = (
    "struct<prose:string,nodes:array<struct<i:int,last:int,parent:int,tag:string,"
    "attrs:map<string,string>,start:int,stop:int,string:string>>>"
)
# Elements that never have content, and those whose text is not prose.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SILENT = frozenset(("script", "style", "template"))
HEADINGS = ("h1", "h2", "h3", "h4")
LONG_NUMBER = re.compile("&#([0-9]{4301,})")  # more digits than Python reads
PIECE = 1 << 20  # characters of html whose nodes leave the parser together


class _Flat(HTMLParser):
    """Pre-order nodes, each with its last descendant and its span of the prose.

    The prose is all text of the page in order, so the text below any node is
    one slice of it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.depths: dict[str, list[int]] = {}  # places in ``open`` of each open tag
        self.prose: list[str] = []
        self.length = 0

    def _add(self, tag: str, attrs: dict, string: str | None) -> int:
        i, at = len(self.nodes), self.length
        parent = self.open[-1] if self.open else -1
        self.nodes.append(
            {"i": i, "last": i, "parent": parent, "tag": tag, "attrs": attrs,
             "start": at, "stop": at, "string": string}
        )
        return i

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section that the tokenizer knows: as in HTML it ends at the next >
            return self.parse_bogus_comment(i, 0)

    def handle_starttag(self, tag, attrs):
        i = self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in reversed(attrs)}, None)

    def handle_endtag(self, tag):
        if self.depths.get(tag):
            self._close_to(self.depths[tag][-1])

    def handle_data(self, data):
        silent = self.open and self.nodes[self.open[-1]]["tag"] in SILENT
        i = self._add("#raw" if silent else "#text", {}, data)
        if not silent:
            self.prose.append(data)
            self.length += len(data)
            self.nodes[i]["stop"] = self.length

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            self.depths[node["tag"]].pop()
            node["last"], node["stop"] = len(self.nodes) - 1, self.length

    def done(self, broken: bool = False) -> dict:
        if not broken:
            self.close()
        self._close_to(0)
        kids: dict[int, list[int]] = {}
        for n in self.nodes:
            kids.setdefault(n["parent"], []).append(n["i"])
        for n in reversed(self.nodes):  # an only child's string is its parent's
            own = kids.get(n["i"], ())
            if len(own) == 1:
                n["string"] = self.nodes[own[0]]["string"]
        return {"prose": "".join(self.prose), "nodes": self.nodes}


def _flatten(html: str | None) -> dict:
    parser = _Flat()
    try:
        parser.feed(html or "")
        return parser.done()
    except ValueError:  # a reference with more digits than a number may have
        short = LONG_NUMBER.sub(lambda m: "&#" + (m[1].lstrip("0") or "0")[:8], html or "")  # eight digits are beyond all code points too
        if short != html:
            return _flatten(short)
    except AssertionError:
        pass
    return parser.done(broken=True)  # markup the tokenizer gives up on: what came before it counts


def _columns(pages: list[dict]) -> pa.Array:
    """Parsed pages as one Arrow array of PAGE."""
    nodes = [n for page in pages for n in page["nodes"]]
    ends, pairs = [0], [0]
    for page in pages:
        ends.append(ends[-1] + len(page["nodes"]))
    for n in nodes:
        pairs.append(pairs[-1] + len(n["attrs"]))
    texts = lambda values: pa.array(list(values), pa.string())
    attrs = pa.MapArray.from_arrays(
        pa.array(pairs, pa.int32()), texts(k for n in nodes for k in n["attrs"]), texts(v for n in nodes for v in n["attrs"].values())
    )
    number = lambda name: pa.array([n[name] for n in nodes], pa.int32())
    fields = {
        "i": number("i"), "last": number("last"), "parent": number("parent"), "tag": texts(n["tag"] for n in nodes),
        "attrs": attrs, "start": number("start"), "stop": number("stop"), "string": texts(n["string"] for n in nodes),
    }
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    return pa.StructArray.from_arrays([texts(page["prose"] for page in pages), lists], ["prose", "nodes"])


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Parsed pages in pieces of about ``PIECE`` characters, however many rows a batch has."""
    for batch in batches:
        pages, held = [], 0
        for text in batch:
            text = text.as_py()
            pages.append(_flatten(text))
            held += len(text or "")
            if held >= PIECE:
                yield _columns(pages)
                pages, held = [], 0
        if pages:
            yield _columns(pages)


def with_nodes(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``prose`` and ``nodes`` of each page; the one step that runs in Python."""

    @F.arrow_udf(PAGE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _parsed(batches)

    # Else a filter on what was parsed is pushed below the spreading: every page parsed once more, by the few tasks that read.
    parse = parse.asNondeterministic()
    return spread_small(df).withColumn("__page", parse(html)).select(
        *df.columns, F.col("__page.prose").alias("prose"), F.col("__page.nodes").alias("nodes")
    )


def text_of(node: Column) -> Column:
    """All prose below a node."""
    return F.substring(F.col("prose"), node["start"] + 1, node["stop"] - node["start"])


def tight_text_of(node: Column) -> Column:
    """The stripped pieces of prose below a node, joined without gaps; empty without a node."""
    # Nodes are in order, so those below one are a slice, cut once and not told again at every node of the page.
    below = F.slice(F.col("nodes"), node["i"] + 1, node["last"] - node["i"] + 1)
    parts = F.filter(below, lambda n: n["tag"] == "#text")
    return F.coalesce(F.array_join(F.transform(parts, lambda n: strip(n["string"])), ""), F.lit(""))


def elements(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(list(tags)))


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def has_class(node: Column, name: str) -> Column:
    classes = F.split(F.coalesce(attr(node, "class"), F.lit("")), "[" + WHITESPACE + "]+")
    return F.array_contains(classes, name)
