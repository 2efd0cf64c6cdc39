"""Typed rows from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as p
from ..operators.registry import Parser, Registry
from .base import cte, derive, query


# The five references, with or without their semicolon, as an HTML tokenizer reads them in text.
TITLE_SQL = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _ref, _char in (("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#x27", "''"), ("&amp", "&")):
    TITLE_SQL = f"regexp_replace({TITLE_SQL}, '{_ref};?', '{_char}', 'g')"


@query("extract_page", f"SELECT page_id, url, trim({TITLE_SQL}) AS title FROM pages")
def extract_page(t):
    return p.extract_page(t.pages).select("page_id", "url", "title")


@query("extract_page_fields")
def extract_page_fields(t):
    profile = p.PageProfile(default_description="none", product="", source_host="/the")
    return p.extract_page(t.pages, profile)


@query(
    "extract_sections",
    """SELECT page_id, url AS source, 'Part ' || page_id AS title, 'about ' || url || ' more' AS content FROM pages
UNION ALL SELECT page_id, url, 'Next', 'end' FROM pages""",
)
def extract_sections(t):
    """Each page with two headed parts put before its article."""
    parts = F.format_string(
        "<section><h2> Part %s</h2>about %s <p> more</p><p>a<b>c</b></p><h3>Next</h3><i>end</i></section><article>",
        F.col("page_id").cast("string"), F.replace("url", F.lit("&"), F.lit("&amp;")),
    )
    marked = t.pages.withColumn("html", F.replace("html", F.lit("<article>"), parts))
    return p.extract_sections(marked).select("page_id", "source", "title", "content")


CVE_TEXT = {
    "page_id": "page_id",
    "url": "url",
    "content": "CASE WHEN page_id % 3 = 0 THEN concat('Found CVE-20', CAST(10 + page_id % 15 AS VARCHAR(9)), '-', CAST(1000 + page_id AS VARCHAR(9)), ' in ', url, ' and CVE-2001-0001') "
    "WHEN page_id % 3 = 1 THEN concat('CVE-99-1 ', url) ELSE url END",
}


@query(
    "cve_rows",
    f"""WITH {cte("d", "pages", CVE_TEXT)} SELECT page_id, 'Vulnerability: ' || regexp_extract(content, 'CVE-[0-9]{{4}}-[0-9]{{4,}}') AS title, content
FROM d WHERE regexp_matches(content, 'CVE-[0-9]{{4}}-[0-9]{{4,}}')""",
)
def cve_rows(t):
    d = derive(t.pages, CVE_TEXT)
    return p.cve_rows(d, F.array("content"), ["page_id"]).select("page_id", "title", "content")


@query(
    "extract_cves",
    """SELECT page_id, url AS source, 'Vulnerability: CVE-2024-' || (10000 + page_id) AS title, 'see CVE-2024-' || (10000 + page_id) || ' now' AS content FROM pages""",
)
def extract_cves(t):
    """Each page with a paragraph that names a vulnerability put into its body."""
    note = F.concat(F.lit("<p> see CVE-2024-"), (F.col("page_id") + 10000).cast("string"), F.lit(" now </p></article>"))
    marked = t.pages.withColumn("html", F.replace("html", F.lit("</article>"), note))
    return p.extract_cves(marked).select("page_id", "source", "title", "content")


@query(
    "extract_best_practices",
    """SELECT page_id, url AS source, 'Rule ' || page_id AS title, 'Rule ' || page_id || ' keep ' || url AS content FROM pages""",
)
def extract_best_practices(t):
    box = F.format_string(
        '<div class="x Best-Practice-box"><h3> Rule %s</h3> keep %s </div>', F.col("page_id").cast("string"), F.col("url")
    )
    marked = t.pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(box, F.lit("<article>"))))
    return p.extract_blocks(marked, "best_practice").select("page_id", "source", "title", "content")


@query(
    "extract_port_rows",
    """SELECT page_id, 'Port ' || (page_id % 1000) || ': svc' AS title, (page_id % 1000) || 'svcx' AS content FROM pages""",
)
def extract_port_rows(t):
    table = F.format_string(
        "<table><tr><th>Port</th><th>S</th></tr><tr><td> %s </td><td>svc</td><td>x</td></tr><tr><td>any</td><td>y</td></tr></table>",
        (F.col("page_id") % 1000).cast("string"),
    )
    marked = t.pages.withColumn("html", F.replace("html", F.lit("<article>"), F.concat(table, F.lit("<article>"))))
    out = p.extract_blocks(marked, "port_info").select("page_id", "title", "content")
    return out.withColumn("content", F.regexp_replace("content", r"\s+", ""))


@query("extract_general")
def extract_general(t):
    return p.extract_blocks(t.pages, "general")


TOOL_PAGE = {
    "page_id": "p_partkey",
    "url": "concat('http://tools/', CAST(p_partkey AS VARCHAR(20)))",
    "html": "concat('<html><h1> ', p_name, '</h1>', CASE WHEN p_size % 2 = 0 THEN concat('<div class=\"big tool-description\">', p_type, ' <b>tool</b></div>') ELSE '' END,"
    " '<pre>run ', p_brand, '</pre><pre> </pre><code>--', lower(p_type), '</code><code>plain</code><code>-x y</code></html>')",
}


@query(
    "extract_tool_page",
    """SELECT p_partkey AS page_id, p_name AS tool_name, p_type || 'tool' AS description, 'run ' || p_brand AS examples, '--' || lower(p_type) || '|-x y' AS common_options
FROM part WHERE p_size % 2 = 0""",
)
def extract_tool_page(t):
    out = p.extract_tool_page(derive(t.part, TOOL_PAGE))
    return out.select(
        "page_id", "tool_name", "description", F.array_join("examples", "|").alias("examples"),
        F.array_join("common_options", "|").alias("common_options"),
    )


VIDEO_TEXT = {
    "page_id": "page_id",
    "url": "url",
    "html": "concat(html, ' https://www.youtube.com/watch?v=a_', CAST(page_id AS VARCHAR(9)), '\" and http://youtu.be/B-', CAST(page_id % 7 AS VARCHAR(9)), '?t=1')",
}


@query(
    "extract_videos",
    f"""WITH {cte("d", "pages", VIDEO_TEXT)}, e AS (SELECT page_id, unnest(regexp_extract_all(html, '(https?://(?:www\\.)?(?:youtube\\.com/watch\\?v=|youtu\\.be/)([\\w-]+))', 1)) AS video_url,
 unnest(regexp_extract_all(html, '(https?://(?:www\\.)?(?:youtube\\.com/watch\\?v=|youtu\\.be/)([\\w-]+))', 2)) AS video_id FROM d)
SELECT page_id, video_url, video_id, 'YouTube Video ' || video_id AS title, 'YouTube' AS platform, 0.95::DOUBLE AS extraction_confidence FROM e""",
)
def extract_videos(t):
    out = p.extract_videos(derive(t.pages, VIDEO_TEXT))
    return out.select("page_id", "video_url", "video_id", "title", "platform", "extraction_confidence")


@query(
    "link_edges",
    """WITH l AS (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT url AS src, split_part(url, ':', 1) || '://' || split_part(url, '/', 3) || replace(href, '&amp;', '&') AS dst FROM l
WHERE NOT regexp_matches(href, '(\\.pdf|\\.zip|\\.tar\\.gz|\\.jpg|\\.png)$')""",
)
def link_edges(t):
    return p.link_edges(t.pages)


def registry() -> Registry:
    r = Registry()
    r.register_parser(
        Parser("article", lambda df: p.extract_page(df), ("page_id", "url", "title"), F.col("html").contains("<article"), 5), True
    )
    r.register_parser(
        Parser("english", lambda df: p.extract_page(df), ("page_id", "url", "title", "license"), F.col("url").contains("/en/"), 9)
    )
    r.register_parser(Parser("off", lambda df: df, ("page_id",), F.lit(True), 99, enabled=False))
    return r


@query(
    "parser_routing",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'article' WHEN contains(url, '/en/') THEN 'english' ELSE 'article' END AS parser FROM pages""",
)
def parser_routing(t):
    hinted = t.pages.withColumn("hint", F.when(F.col("page_id") % 2 == 0, "article").otherwise("off"))
    return registry().parse_all(hinted, "hint").select("page_id", "parser")


@query(
    "enrichers",
    """SELECT page_id, length(html) AS n_chars, upper(split_part(url, '/', 4)) AS section, CASE WHEN length(html) <= 2000 THEN 'size' ELSE '' END AS failed FROM pages""",
)
def enrichers(t):
    r = Registry()
    r.register_enricher("size", lambda df: df.withColumn("n_chars", F.length("html").cast("bigint")), "n_chars > 2000")
    r.register_enricher("section", lambda df: df.withColumn("section", F.upper(F.split("url", "/")[3])))
    failed = F.array_join(F.transform("enrichment_errors", lambda e: e["enricher"]), ",")
    return r.enrich(t.pages).select("page_id", "n_chars", "section", failed.alias("failed"))


# What the pages have, and behind it accounts, videos and places of every sort, some of them wrong.
TYPED_TEXT = {
    "page_id": "page_id",
    "url": "url",
    "html": """concat(html, '<p><a href="https://twitter.com/acct', page_id, '">t</a> <a href="https://www.GitHub.com/org', page_id % 7, '/repo?x=1">g</a>',
 ' <a href="https://github.com/">home</a> https://youtu.be/vid', page_id, '</p><meta name="geo.position" content="', page_id % 200 - 90, '.5; ', page_id % 360 - 180, '.25">',
 '<meta name="ICBM" content="nowhere"><meta name="description" content="1,2">')""",
}
VIDEO_RE = r"(https?://(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([\w-]+))"
TYPED_SQL = rf"""WITH {cte("d", "pages", TYPED_TEXT)},
h AS (SELECT page_id, url, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: CASE WHEN x LIKE '/%' THEN split_part(url, ':', 1) || '://' || split_part(url, '/', 3) ELSE '' END || replace(x, '&amp;', '&')) AS links,
 regexp_extract_all(html, '{VIDEO_RE}', 1) AS va, regexp_extract_all(html, '{VIDEO_RE}', 2) AS vb FROM d),
s AS (SELECT page_id, url, list_filter(links, lambda x: regexp_matches(lower(x), '^https?://(www\.)?(twitter|github)\.com/[^/?#]')) AS soc FROM h),
r AS (SELECT page_id, url, 'link' AS kind, generate_subscripts(links, 1) - 1 AS position, unnest(links) AS value, NULL AS detail FROM h
 UNION ALL SELECT page_id, url, 'social', generate_subscripts(soc, 1) - 1, unnest(soc), unnest(list_transform(soc, lambda x: regexp_extract(lower(x), '(twitter|github)\.com/', 1) || '/' || regexp_extract(x, '^[a-z]+://[^/]+/([^/?#]+)', 1))) FROM s
 UNION ALL SELECT page_id, url, 'video', generate_subscripts(va, 1) - 1, unnest(va), unnest(vb) FROM h
 UNION ALL SELECT page_id, url, 'geo', 0, (page_id % 200 - 90) || '.5,' || (page_id % 360 - 180) || '.25', 'geo.position' FROM pages WHERE abs(((page_id % 200 - 90) || '.5')::DOUBLE) <= 90 AND abs(((page_id % 360 - 180) || '.25')::DOUBLE) <= 180)
SELECT page_id, url, kind, position::INTEGER AS position, value, detail FROM r"""


@query("typed_extractors", TYPED_SQL)
def typed_extractors(t):
    """Links, accounts, videos and places of every page, out of one parse."""
    r = Registry()
    r.register_extractor("typed", p.typed_rows)
    return r.extract_all(derive(t.pages, TYPED_TEXT))
