"""Typed rows out of crawled pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import content_hash, strip, truthy
from ..functions.html import HEADINGS, attr, elements, first, has_class, text_of, tight_text_of, with_nodes
from ..functions.urls import follow_link, join_url

__all__ = ["content_hash"]

# Patterns read out of page text.
CVE_PATTERN = r"CVE-[0-9]{4}-[0-9]{4,}"
VIDEO_PATTERN = r"(https?://(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([\w-]+))"
OPTION_PATTERN = r"^(-{1,2}\w+)"
VIDEO_CONFIDENCE = 0.95
VIDEO_PLATFORM = "YouTube"
EMBED_CODE = (
    '<iframe width="560" height="315" src="https://www.youtube.com/embed/%s" '
    'frameborder="0" allowfullscreen></iframe>'
)
MAX_EXAMPLE = 500
KINDS = ("best_practice", "port_info", "general")


@dataclass(frozen=True)
class PageProfile:
    """What a product page parser looks for besides the general fields."""

    default_title: str = ""
    default_description: str = ""
    product: str = ""
    source_host: str = "github.com/"
    default_source: str | None = None


def extract_page(df: DataFrame, profile: PageProfile = PageProfile()) -> DataFrame:
    """(page_id, url, title, description, version, license, source_code_url)."""
    n = F.col("nodes")
    page = with_nodes(df)
    text = lambda e: strip(text_of(e))
    title = strip(first(elements(n, "title"))["string"])
    metas = F.filter(elements(n, "meta"), lambda m: attr(m, "name") == "description")
    h1, p = first(elements(n, "h1")), first(elements(n, "p"))
    description = F.coalesce(
        F.nullif(strip(attr(first(metas), "content")), F.lit("")),
        F.when(truthy(text_of(h1)), text(h1)),
        F.when(h1.isNull() | ~truthy(text_of(h1)), F.nullif(text(p), F.lit(""))),
        F.lit(profile.default_description),
    )
    named = F.filter(
        F.transform(elements(n, "b", "strong", "p"), lambda e: text_of(e)),
        lambda t: F.lower(t).contains("version") & F.lower(t).contains(profile.product.lower()),
    )
    pattern = rf"(?U){profile.product}[\s\w\-]*([0-9]+\.[0-9]+(\.[0-9]+)?)"
    version = first(
        F.filter(F.transform(named, lambda t: F.regexp_extract(t, pattern, 1)), lambda v: v != "")
    )
    links = F.filter(elements(n, "a"), lambda a: attr(a, "href").isNotNull())
    licensed = F.filter(
        links,
        lambda a: F.lower(attr(a, "href")).contains("license")
        | F.lower(text_of(a)).contains("license"),
    )
    mentions = F.filter(
        elements(n, "p", "li", "a"), lambda e: F.lower(text_of(e)).contains("license")
    )
    license_ = F.coalesce(
        F.nullif(text(first(licensed)), F.lit("")), text(first(mentions))
    )
    source = F.coalesce(
        first(
            F.filter(
                F.transform(links, lambda a: attr(a, "href")),
                lambda h: h.contains(profile.source_host),
            )
        ),
        F.lit(profile.default_source).cast("string"),
    )
    return page.select(
        "page_id", "url",
        F.coalesce(F.nullif(title, F.lit("")), F.lit(profile.default_title)).alias("title"),
        F.when(truthy(description), description).alias("description"),
        version.alias("version"),
        F.nullif(license_, F.lit("")).alias("license"),
        source.alias("source_code_url"),
    )


def _knowledge(df: DataFrame, items: Column, kind: str) -> DataFrame:
    """One knowledge row per (title, content) item."""
    return (
        df.select("page_id", F.col("url").alias("source"), F.posexplode(items).alias("position", "item"))
        .select(
            "page_id", "source", F.lit(kind).alias("type"), "position",
            F.col("item.title").alias("title"), F.col("item.content").alias("content"),
        )
    )


def extract_sections(df: DataFrame) -> DataFrame:
    """A row per heading with the text of the siblings up to the next heading."""
    n = F.col("nodes")

    def section(h: Column) -> Column:
        later = F.filter(n, lambda x: (x["parent"] == h["parent"]) & (x["i"] > h["i"]))
        stop = F.array_min(
            F.transform(F.filter(later, lambda x: x["tag"].isin(list(HEADINGS))), lambda x: x["i"])
        )
        own = F.filter(
            later, lambda x: (stop.isNull() | (x["i"] < stop)) & F.coalesce(x["string"] != "", F.lit(False))
        )
        return F.struct(
            strip(text_of(h)).alias("title"),
            F.array_join(F.transform(own, lambda x: strip(x["string"])), " ").alias("content"),
            F.size(own).alias("parts"),
        )

    page = with_nodes(df)
    items = F.filter(F.transform(elements(n, *HEADINGS), section), lambda s: s["parts"] > 0)
    return _knowledge(page, items, "documentation")


def cve_rows(df: DataFrame, texts: Column, keep: list[str]) -> DataFrame:
    """A row per text that names a vulnerability; the first name is the title."""
    return (
        df.select(*keep, F.posexplode(texts).alias("position", "content"))
        .filter(F.col("content").rlike(CVE_PATTERN))
        .select(
            *keep, "position",
            F.concat(F.lit("Vulnerability: "), F.regexp_extract("content", f"({CVE_PATTERN})", 1)).alias("title"),
            "content",
        )
    )


def extract_cves(df: DataFrame) -> DataFrame:
    """Vulnerability rows from the stripped text nodes of pages."""
    page = with_nodes(df)
    texts = F.filter(
        F.transform(elements(F.col("nodes"), "#text"), lambda x: strip(x["string"])), lambda t: t != ""
    )
    rows = cve_rows(page, texts, ["page_id", "url"])
    return rows.select(
        "page_id", F.col("url").alias("source"), F.lit("vulnerability").alias("type"),
        "position", "title", "content",
    )


def extract_blocks(df: DataFrame, kind: str) -> DataFrame:
    """``best_practice`` boxes, ``port_info`` table rows or the ``general`` body."""
    n, page = F.col("nodes"), with_nodes(df)
    inside = lambda outer, *tags: F.filter(
        elements(n, *tags), lambda x: (x["i"] > outer["i"]) & (x["i"] <= outer["last"])
    )
    text = lambda e: strip(text_of(e))
    if kind == "best_practice":
        boxes = F.filter(
            elements(n, "div", "section"),
            lambda d: F.exists(
                F.split(F.coalesce(F.lower(attr(d, "class")), F.lit("")), r"\s+"),
                lambda c: c.contains("best-practice"),
            )
            & (F.size(inside(d, *HEADINGS)) > 0),
        )
        items = F.transform(
            boxes,
            lambda d: F.struct(text(first(inside(d, *HEADINGS))).alias("title"), text(d).alias("content")),
        )
    elif kind == "port_info":
        def row(r: Column) -> Column:
            cells = inside(r, "td")
            port = text(F.get(cells, F.lit(0)))
            return F.struct(
                F.concat(F.lit("Port "), port, F.lit(": "), text(F.get(cells, F.lit(1)))).alias("title"),
                text(r).alias("content"),
                ((F.size(cells) >= 2) & port.rlike("^[0-9]+$")).alias("ok"),
            )

        tables = elements(n, "table")
        rows = F.filter(
            elements(n, "tr"),
            lambda r: F.exists(tables, lambda t: (t["i"] < r["i"]) & (r["last"] <= t["last"])),
        )
        items = F.filter(F.transform(rows, row), lambda s: F.coalesce(s["ok"], F.lit(False)))
    elif kind == "general":
        body = F.coalesce(
            first(elements(n, "main")),
            first(elements(n, "article")),
            first(F.filter(elements(n, "div"), lambda d: has_class(d, "content"))),
        )
        title = first(elements(n, "title"))
        named = F.when(title.isNull(), F.col("url")).otherwise(title["string"])
        item = F.struct(named.alias("title"), text(body).alias("content"))
        items = F.filter(F.array(F.when(body.isNotNull(), item)), lambda x: x.isNotNull())
    else:
        raise ValueError(f"kind is one of {KINDS}")
    return _knowledge(page, items, kind)


def extract_tool_page(df: DataFrame) -> DataFrame:
    """Tool pages with a name and a description; others are skipped."""
    n, page = F.col("nodes"), with_nodes(df)
    tight = lambda e: tight_text_of(e)
    described = first(F.filter(elements(n, "div"), lambda d: has_class(d, "tool-description")))
    examples = F.filter(
        F.transform(elements(n, "pre"), tight), lambda t: (t != "") & (F.length(t) < MAX_EXAMPLE)
    )
    options = F.filter(
        F.transform(elements(n, "code"), lambda e: text_of(e)),
        lambda t: t.rlike(f"(?U){OPTION_PATTERN}"),
    )
    return page.select(
        "page_id", "url",
        tight(first(elements(n, "h1"))).alias("tool_name"),
        tight(described).alias("description"),
        examples.alias("examples"),
        options.alias("common_options"),
    ).filter(truthy("tool_name") & truthy("description"))


def extract_videos(df: DataFrame, content: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """A row per video link with its id, platform, confidence and embed code."""
    pattern = F.lit(f"(?U){VIDEO_PATTERN}")
    pairs = F.arrays_zip(
        F.regexp_extract_all(content, pattern, 1).alias("video_url"),
        F.regexp_extract_all(content, pattern, 2).alias("video_id"),
    )
    rows = df.select(*keep, F.posexplode(pairs).alias("position", "v"))
    return rows.select(
        *keep, "position",
        F.col("v.video_url").alias("video_url"),
        F.col("v.video_url").alias("specific_source_url"),
        F.col("v.video_id").alias("video_id"),
        F.concat(F.lit("YouTube Video "), F.col("v.video_id")).alias("title"),
        F.lit(VIDEO_PLATFORM).alias("platform"),
        F.lit(VIDEO_CONFIDENCE).alias("extraction_confidence"),
        F.format_string(EMBED_CODE, F.col("v.video_id")).alias("embed_code"),
    )


# Hosts of accounts, without "www.", and their platforms.
SOCIAL_HOSTS = {
    "twitter.com": "twitter", "x.com": "twitter", "facebook.com": "facebook", "linkedin.com": "linkedin", "github.com": "github",
    "gitlab.com": "gitlab", "instagram.com": "instagram", "reddit.com": "reddit", "mastodon.social": "mastodon", "t.me": "telegram",
}
GEO_NAMES = ("geo.position", "icbm")  # fixed values: names of meta elements that hold a place


def typed_rows(df: DataFrame, kinds: tuple[str, ...] = ("link", "social", "video", "geo")) -> DataFrame:
    """(page_id, url, kind, position, value, detail) of everything typed in a page, from one parse.

    link: an anchor's absolute address; social: the same of an account on a known platform, with
    ``platform/account``; video: its address and id; geo: ``latitude,longitude`` of a meta element within
    their ranges, with the element's name.  Positions count from 0 within a page and kind.
    """
    page = with_nodes(df)
    item = lambda kind, value, detail: F.struct(F.lit(kind).alias("kind"), value.alias("value"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    anchors = F.filter(elements(F.col("nodes"), "a"), lambda a: attr(a, "href").isNotNull())
    links = F.transform(anchors, lambda a: join_url(F.col("url"), attr(a, "href")))

    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    account = lambda u: F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+/([^/?#]+)", 1)
    platforms = F.create_map(*[F.lit(x) for pair in SOCIAL_HOSTS.items() for x in pair])
    accounts = F.filter(links, lambda u: F.try_element_at(platforms, host(u)).isNotNull() & (account(u) != ""))
    socials = F.transform(
        accounts, lambda u: item("social", u, F.concat(F.try_element_at(platforms, host(u)), F.lit("/"), account(u)))
    )
    pattern = F.lit(f"(?U){VIDEO_PATTERN}")
    seen = F.arrays_zip(
        F.regexp_extract_all("html", pattern, 1).alias("a"), F.regexp_extract_all("html", pattern, 2).alias("b")
    )
    videos = F.transform(seen, lambda v: item("video", v["a"], v["b"]))
    metas = F.transform(
        F.filter(elements(F.col("nodes"), "meta"), lambda m: F.lower(F.coalesce(attr(m, "name"), F.lit(""))).isin(list(GEO_NAMES))),
        lambda m: F.struct(
            F.split(F.coalesce(attr(m, "content"), F.lit("")), r"\s*[;,]\s*").alias("at"), F.lower(attr(m, "name")).alias("name")
        ),
    )
    number = lambda m, i: F.trim(F.get(m["at"], F.lit(i))).try_cast("double")
    within = lambda x, most: F.coalesce(F.abs(x) <= most, F.lit(False))
    places = F.filter(metas, lambda m: (F.size(m["at"]) == 2) & within(number(m, 0), 90) & within(number(m, 1), 180))
    geo = F.transform(
        places, lambda m: item("geo", F.array_join(F.transform(m["at"], lambda x: F.trim(x)), ","), m["name"])
    )
    found = {"link": F.transform(links, lambda u: item("link", u, none)), "social": socials, "video": videos, "geo": geo}
    numbered = [
        F.transform(found[k], lambda x, i: F.struct(x["kind"], i.alias("position"), x["value"], x["detail"])) for k in kinds
    ]
    return page.select("page_id", "url", F.inline(F.concat(*numbered)))


def link_edges(df: DataFrame, only_followed: bool = True) -> DataFrame:
    """(src, dst) of every anchor, made absolute; by default only followed ones."""
    page = with_nodes(df)
    hrefs = F.filter(
        F.transform(elements(F.col("nodes"), "a"), lambda a: attr(a, "href")), lambda h: h.isNotNull()
    )
    out = page.select(F.col("url").alias("src"), F.explode(hrefs).alias("href")).select(
        "src", join_url("src", "href").alias("dst")
    )
    if only_followed:
        out = out.filter(follow_link("dst", "src"))
    return out.distinct()
