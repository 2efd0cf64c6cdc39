"""Field clean-up, ids, quality, search and log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as f
from ..operators import normalize, quality, search
from ..sources.io import export_columns
from .base import NOW_TEXT, cte, derive, now, query

NOW_SQL = f"TIMESTAMP '{NOW_TEXT}'"

# A raw tool record made from each part, with gaps of every kind.
RAW = {
    "part_id": "p_partkey",
    "tool_name": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('  ', p_name, ' ') END",
    "source_url": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('http://', lower(p_type), '.example.com/', CAST(p_size AS VARCHAR(20))) END",
    "official_site_url": "CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN NULL ELSE concat('http://home/', p_brand) END",
    "website": "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('http://www/', p_type) END",
    "version": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE CAST(p_size AS VARCHAR(20)) END",
    "tool_version": "CASE WHEN p_partkey % 6 = 0 THEN concat('v', CAST(p_size AS VARCHAR(20))) ELSE NULL END",
    "license": "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' ELSE 'MIT' END",
    "licence": "CASE WHEN p_partkey % 14 = 0 THEN 'GPL' ELSE NULL END",
    "description": "CASE WHEN p_partkey % 9 = 0 THEN '   ' WHEN p_partkey % 9 = 1 THEN NULL ELSE concat('A ', p_name, ' of ', p_brand) END",
    "categories": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_type, ', ,', p_brand, ' ,') END",
    "tags": "CASE WHEN p_partkey % 8 = 0 THEN '' ELSE concat(' ', p_type, ',', p_name, ',  ') END",
}
RAW_CTE = cte("raw", "part", RAW)

DATES = {
    "row_id": "event_id",
    "s": "CASE event_id % 11 "
    "WHEN 0 THEN '2024-03-05T04:05:06.123456Z' WHEN 1 THEN '2024-03-05T04:05:06Z' "
    "WHEN 2 THEN '2024-03-05 04:05:06' WHEN 3 THEN '2024-03-05' WHEN 4 THEN 'March 15, 2023' "
    "WHEN 5 THEN 'Mar 15, 2023' WHEN 6 THEN '15 March 2023' WHEN 7 THEN '15 Mar 2023' "
    "WHEN 8 THEN 'on' WHEN 9 THEN concat('junk ', event_type) ELSE '  ' END",
}

LABELLED = """labelled AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
LABELLED_FIELDS = ("text", "lang", "source", "quality", "toxic")
SCORED = f"""scored AS (
  SELECT *, round(100.0 * ((CASE WHEN text <> '' THEN 1 ELSE 0 END) + (CASE WHEN lang <> '' THEN 1 ELSE 0 END)
    + (CASE WHEN source <> '' THEN 1 ELSE 0 END) + (CASE WHEN quality <> 0 THEN 1 ELSE 0 END)
    + (CASE WHEN toxic <> 0 THEN 1 ELSE 0 END)) / 5, 1) AS score
  FROM labelled)"""
RANK_SQL = (
    "CASE WHEN score >= 95 THEN 'S' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' "
    "WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END"
)


def labelled(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", "quality", "toxic"
    )


@query(
    "quality_rank_counts",
    f"""WITH {LABELLED}, {SCORED},
ranked AS (SELECT {RANK_SQL} AS quality_rank FROM scored)
SELECT quality_rank, count(*) AS n, (SELECT count(*) FROM ranked) AS total FROM ranked GROUP BY quality_rank""",
)
def quality_rank_counts(t):
    return quality.rank_counts(quality.quality_score(labelled(t), LABELLED_FIELDS))


@query(
    "quality_score_rows",
    f"""WITH {LABELLED}, {SCORED}
SELECT doc_id, CAST(score AS DOUBLE) AS data_quality_score, {RANK_SQL} AS quality_rank FROM scored""",
)
def quality_score_rows(t):
    out = quality.quality_score(labelled(t), LABELLED_FIELDS)
    return out.select("doc_id", "data_quality_score", "quality_rank")


@query(
    "missing_fields",
    f"""WITH {LABELLED},
m AS (SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR text IN ('', '{{}}') THEN 'text' END,
  CASE WHEN lang IS NULL OR lang IN ('', '{{}}') THEN 'lang' END,
  CASE WHEN source IS NULL OR source IN ('', '{{}}') THEN 'source' END,
  CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS missing,
  round(100.0 * ((CASE WHEN text IS NULL OR text IN ('', '{{}}') THEN 0 ELSE 1 END)
   + (CASE WHEN lang IS NULL OR lang IN ('', '{{}}') THEN 0 ELSE 1 END)
   + (CASE WHEN source IS NULL OR source IN ('', '{{}}') THEN 0 ELSE 1 END)
   + (CASE WHEN quality IS NULL THEN 0 ELSE 1 END) + (CASE WHEN toxic IS NULL THEN 0 ELSE 1 END)) / 5, 1) AS score
  FROM labelled)
SELECT doc_id, missing, CAST(score AS DOUBLE) AS score, {RANK_SQL} AS rank FROM m""",
)
def missing_fields(t):
    out = quality.missing_fields(labelled(t), LABELLED_FIELDS)
    return out.select("doc_id", F.array_join("missing", ",").alias("missing"), "score", "rank")


@query(
    "completion_pct",
    f"""WITH {LABELLED}
SELECT CAST(floor(100 * ((CASE WHEN text <> '' THEN 1 ELSE 0 END) + (CASE WHEN lang <> '' THEN 1 ELSE 0 END)
  + (CASE WHEN source <> '' THEN 1 ELSE 0 END) + (CASE WHEN quality <> 0 THEN 1 ELSE 0 END)
  + (CASE WHEN toxic <> 0 THEN 1 ELSE 0 END)) / 9) AS INTEGER) AS pct, count(*) AS n
FROM labelled GROUP BY 1""",
)
def completion_pct(t):
    df = labelled(t)
    fields = [*LABELLED_FIELDS, "license", "version", "tags", "dependencies"]
    return df.groupBy(quality.completion_pct(df, fields).alias("pct")).agg(F.count("*").alias("n"))


@query(
    "field_completeness",
    f"""WITH {LABELLED}, c AS (SELECT count(*) AS r,
 count(CASE WHEN text <> '' THEN 1 END) AS a, count(CASE WHEN lang <> '' THEN 1 END) AS b,
 count(CASE WHEN source <> '' THEN 1 END) AS c, count(quality) AS d, count(toxic) AS e FROM labelled)
SELECT 'text' AS field, round(100.0 * a / r, 1) AS pct FROM c UNION ALL SELECT 'lang', round(100.0 * b / r, 1) FROM c
UNION ALL SELECT 'source', round(100.0 * c / r, 1) FROM c UNION ALL SELECT 'quality', round(100.0 * d / r, 1) FROM c
UNION ALL SELECT 'toxic', round(100.0 * e / r, 1) FROM c""",
)
def field_completeness(t):
    return quality.field_completeness(labelled(t), LABELLED_FIELDS)


EXPECTED_COLUMNS = {"documents": 5, "labels": 3, "pages": 4, "events": 8}


@query(
    "table_health",
    """SELECT 'documents' AS name, 'healthy' AS status, 5 AS columns, count(*) AS "rows" FROM documents
UNION ALL SELECT 'labels', 'healthy', 3, count(*) FROM labels
UNION ALL SELECT 'pages', 'warning', 3, count(*) FROM pages
UNION ALL SELECT 'events', 'danger', 6, count(*) FROM events""",
)
def table_health(t):
    tables = {n: getattr(t, n) for n in EXPECTED_COLUMNS}
    return quality.table_health(tables, EXPECTED_COLUMNS)


@query(
    "table_schema",
    """SELECT 'documents' AS table_name, (row_number() OVER ())::INTEGER AS ordinal, column_name,
 CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS column_type,
 (SELECT least(10, count(*)) FROM documents) AS sampled_rows FROM (DESCRIBE documents)""",
)
def table_schema(t):
    df = t.documents
    sample = quality.table_sample(df, 10).agg(F.count("*")).scalar()
    return quality.table_schema(df, "documents").withColumn("sampled_rows", sample)


@query(
    "coalesce_fields",
    f"""WITH {RAW_CTE}
SELECT part_id, coalesce(nullif(official_site_url, ''), nullif(website, '')) AS website,
 coalesce(nullif(license, ''), nullif(licence, '')) AS license,
 coalesce(nullif(version, ''), nullif(tool_version, '')) AS version FROM raw""",
)
def coalesce_fields(t):
    return derive(t.part, RAW).select(
        "part_id",
        f.coalesce_fields("official_site_url", "website").alias("website"),
        f.coalesce_fields("license", "licence").alias("license"),
        f.coalesce_fields("version", "tool_version").alias("version"),
    )


@query(
    "with_placeholder",
    f"""WITH {RAW_CTE} SELECT part_id, CASE WHEN description IS NULL OR trim(description) = ''
 THEN 'No description available' ELSE description END AS description FROM raw""",
)
def with_placeholder(t):
    text = f.with_placeholder("description", normalize.DESCRIPTION_PLACEHOLDER)
    return derive(t.part, RAW).select("part_id", text.alias("description"))


@query(
    "to_string_array",
    f"""WITH {RAW_CTE} SELECT part_id,
 array_to_string(list_filter(list_transform(string_split(coalesce(categories, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS categories,
 array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS tags
FROM raw""",
)
def to_string_array(t):
    return derive(t.part, RAW).select(
        "part_id",
        F.array_join(f.to_string_array("categories"), "|").alias("categories"),
        F.array_join(f.to_string_array("tags", lower=True), "|").alias("tags"),
    )


@query(
    "parse_timestamp_multi",
    f"""WITH {cte("d", "events", DATES)}
SELECT row_id, CASE WHEN trim(s) = '' THEN NULL ELSE coalesce(
 try_strptime(s, '%Y-%m-%dT%H:%M:%S.%fZ'), try_strptime(s, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(s, '%Y-%m-%d %H:%M:%S'),
 try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%B %d, %Y'), try_strptime(s, '%b %d, %Y'),
 try_strptime(s, '%d %B %Y'), try_strptime(s, '%d %b %Y'), {NOW_SQL}) END AS parsed FROM d""",
)
def parse_timestamp_multi(t):
    return derive(t.events, DATES).select("row_id", f.parse_timestamp_multi("s", now()).alias("parsed"))


SEEN = {
    "row_id": "event_id",
    "first_seen": "CASE WHEN event_id % 3 = 0 THEN ts ELSE NULL END",
    "last_seen": "CASE WHEN event_id % 4 = 0 THEN ts ELSE NULL END",
}


@query(
    "backfill_seen",
    f"""WITH {cte("d", "events", SEEN)}
SELECT row_id, coalesce(first_seen, last_seen, {NOW_SQL}) AS first_seen,
 coalesce(last_seen, first_seen, {NOW_SQL}) AS last_seen FROM d""",
)
def backfill_seen(t):
    return normalize.backfill_seen(derive(t.events, SEEN), "first_seen", "last_seen", now())


@query(
    "strip_nul",
    "SELECT doc_id, text, source || '-' || lang AS inner_text FROM documents",
)
def strip_nul(t):
    nul = F.lit("\x00")
    dirty = t.documents.select(
        "doc_id",
        F.concat(nul, "text", nul).alias("text"),
        F.array(F.struct(F.concat_ws("\x00-", "source", "lang").alias("s"))).alias("deep"),
    )
    clean = normalize.strip_nul(dirty)
    return clean.select("doc_id", "text", F.col("deep")[0]["s"].alias("inner_text"))


@query(
    "stable_id",
    f"""WITH {RAW_CTE} SELECT part_id, md5(lower(trim(tool_name)) || coalesce(source_url, '')) AS tool_id FROM raw""",
)
def stable_id(t):
    return derive(t.part, RAW).select("part_id", f.stable_id("tool_name", "source_url").alias("tool_id"))


@query(
    "prefixed_id",
    """WITH h AS (SELECT page_id, CAST('0x' || substr(sha256(url), 1, 15) AS BIGINT) AS v FROM pages),
i AS (SELECT page_id, 'PAGE_' || list_aggregate([substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((v // CAST(pow(36, k) AS BIGINT)) % 36 + 1 AS BIGINT), 1) FOR k IN range(7, -1, -1)], 'string_agg', '') AS public_id FROM h)
SELECT page_id, public_id, count(*) OVER (PARTITION BY public_id) AS holders FROM i""",
)
def prefixed_id(t):
    ids = t.pages.select("page_id", f.prefixed_id("PAGE_", "url", 8).alias("public_id"))
    holders = ids.groupBy("public_id").agg(F.count("*").alias("holders"))
    return ids.join(holders, "public_id")


REFS = {
    "row_id": "event_id",
    "ref": "CASE event_id % 4 WHEN 0 THEN concat('CVE-2024-', CAST(10000 + user_id AS VARCHAR(20))) "
    "WHEN 1 THEN concat('CWE-', CAST(user_id AS VARCHAR(20))) WHEN 2 THEN concat('cve-', event_type) ELSE event_type END",
}


@query(
    "ref_type",
    f"""WITH {cte("d", "events", REFS)} SELECT row_id, ref, CASE WHEN ref LIKE 'CVE-%' THEN 'CVE'
 WHEN ref LIKE 'CWE-%' THEN 'CWE' ELSE 'OTHER' END AS reference_type FROM d""",
)
def ref_type(t):
    return derive(t.events, REFS).select("row_id", "ref", f.ref_type("ref").alias("reference_type"))


@query(
    "child_tables",
    """WITH c AS (SELECT l_orderkey AS tool, l_shipdate, CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE l_returnflag END AS name,
  l_linenumber FROM lineitem)
SELECT o_orderkey AS tool_id, coalesce(sum(CASE WHEN name <> '' THEN 1 END), 0)::BIGINT AS n_commands,
 coalesce(sum(CASE WHEN name <> '' THEN 2 END), 0)::BIGINT AS n_options
FROM orders LEFT JOIN c ON tool = o_orderkey GROUP BY o_orderkey""",
)
def child_tables(t):
    option = F.struct(F.lit("-v").alias("name"), F.lit(None).cast("string").alias("type"))
    value = F.struct(F.lit("<file>").alias("name"), F.lit(None).cast("string").alias("type"))
    unnamed = F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("type"))
    command = F.struct(
        F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.col("l_returnflag")).alias("name"),
        F.array(option, value, unnamed).alias("options"),
    )
    # Nested input: the list of an order's lines, a handful by the data's definition.
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("tool_id")).agg(
        F.collect_list(command).alias("commands")
    )
    parents = t.orders.select(F.col("o_orderkey").alias("tool_id"))
    commands = normalize.explode_children(nested, "tool_id", "commands", "name")
    options = normalize.explode_children(
        commands.withColumnRenamed("name", "owner"), "tool_id", "options", "name", keep=("owner",)
    )
    return normalize.child_counts(parents, "tool_id", {"commands": commands, "options": options})


@query(
    "workflow_steps",
    """WITH w AS (SELECT doc_id, string_split(text, chr(10)) AS steps FROM documents),
e AS (SELECT doc_id, unnest(steps) AS step_text, unnest(range(1, len(steps) + 1)) AS step_number FROM w)
SELECT doc_id, CAST(step_number AS INTEGER) AS step_number, md5(step_text) AS step_md5 FROM e WHERE step_text <> ''""",
)
def workflow_steps(t):
    flows = t.documents.select(
        "doc_id", F.struct(F.col("source").alias("name"), F.split("text", "\n").alias("steps")).alias("w")
    )
    out = normalize.explode_steps(flows, "doc_id", "w")
    return out.select("doc_id", "step_number", F.md5(F.col("step_text")).alias("step_md5"))


OPTIONS = {
    "row_id": "event_id",
    "name": "CASE WHEN user_id % 2 = 0 THEN concat('<', event_type, '>') ELSE concat('-', event_type) END",
    "type": "CASE WHEN event_id % 5 = 0 THEN 'given' ELSE NULL END",
    "required": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END",
    "default": "CASE WHEN event_id % 7 = 0 THEN 'd' WHEN event_id % 7 = 1 THEN '' ELSE NULL END",
    "example": "CASE WHEN event_id % 11 = 0 THEN 'e' ELSE NULL END",
}
OPTIONS_SQL = {(f'"{k}"' if k == "default" else k): v for k, v in OPTIONS.items()}


@query(
    "option_type",
    f"""WITH {cte("d", "events", OPTIONS_SQL)}
SELECT row_id, CASE WHEN type IS NOT NULL THEN type
 WHEN required = false AND coalesce("default", '') = '' AND coalesce(example, '') = '' THEN 'flag'
 WHEN name LIKE '<%' AND name LIKE '%>' THEN 'variable' ELSE 'option' END AS type FROM d""",
)
def option_type(t):
    df = derive(t.events, {(f"`{k}`" if k == "default" else k): v for k, v in OPTIONS.items()})
    return normalize.infer_option_types(df).select("row_id", "type")


@query(
    "normalize_links",
    """SELECT page_id, url AS link, CAST(NULL AS VARCHAR) AS title, CAST(page_id AS VARCHAR) AS parent_id FROM pages
UNION ALL SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/a' ELSE url || '/b' END,
 CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'title' END,
 CASE WHEN page_id % 4 = 0 THEN 'parent' ELSE CAST(page_id AS VARCHAR) END FROM pages""",
)
def normalize_links(t):
    i = F.col("page_id")
    rich = F.struct(
        F.when(i % 3 == 0, F.concat("url", F.lit("/a"))).when(i % 3 == 1, "").alias("link"),
        F.concat("url", F.lit("/b")).alias("url"),
        F.when(i % 2 == 0, "").otherwise("title").alias("title"),
        F.when(i % 4 == 0, "parent").alias("parent_id"),
    )
    df = t.pages.select("page_id", F.array("url").alias("plain"), F.array(rich).alias("rich"))
    return normalize.normalize_links(df, "page_id", "plain", "rich")


ENRICH = {
    "doc_id": "doc_id",
    "content": "concat('intro ', lang, chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('License: ', upper(source), '-2.0', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 3 = 0 THEN concat('version ', CAST(n_chars AS VARCHAR(20)), '.1', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 4 = 0 THEN concat('runs on LINUX and windows', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 5 = 0 THEN concat('Category: ', source, ' , ', lang, ';', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 6 = 0 THEN concat('Tags: ', upper(lang), ', X', ';', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 7 = 0 THEN concat('Usage:  run ', source, ' ', chr(10)) ELSE '' END,"
    " CASE WHEN doc_id % 8 = 0 THEN concat('Installation: get ', source) ELSE '' END)",
    "license": "CASE WHEN doc_id % 10 = 0 THEN 'kept' ELSE NULL END",
    "version": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE NULL END",
    "usage_summary": "CAST(NULL AS VARCHAR(9))",
    "installation_instructions": "CAST(NULL AS VARCHAR(9))",
}


@query(
    "enrich_from_text",
    f"""WITH {cte("d", "documents", ENRICH)},
x AS (SELECT doc_id,
 CASE WHEN coalesce(license, '') <> '' THEN license ELSE coalesce(nullif(regexp_extract(content, '(?i)License[:\\s]+([\\w\\-\\.]+)', 1), ''), license) END AS license,
 CASE WHEN coalesce(version, '') <> '' THEN version ELSE coalesce(nullif(regexp_extract(content, '(?i)Version[:\\s]+([\\w\\.\\-]+)', 1), ''), version) END AS version,
 array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '(?i)(Windows|Linux|macOS|Unix|BSD|Android|iOS)', 1),
   lambda s: upper(substr(s, 1, 1)) || lower(substr(s, 2))))), '|') AS supported_os,
 array_to_string(list_filter(list_transform(string_split(regexp_extract(content, '(?i)Category[:\\s]+([\\w\\s,\\-/]+)', 1), ','), lambda s: trim(s, E' \\n')), lambda s: s <> ''), '|') AS categories,
 array_to_string(list_filter(list_transform(string_split(regexp_extract(content, '(?i)Tags?[:\\s]+([\\w\\s,\\-/]+)', 1), ','), lambda s: lower(trim(s, E' \\n'))), lambda s: s <> ''), '|') AS tags,
 CASE WHEN regexp_matches(content, '(?i)Usage[:\\s]+(.+?)(?:\\n|$)') THEN trim(regexp_extract(content, '(?i)Usage[:\\s]+(.+?)(?:\\n|$)', 1)) END AS usage_summary,
 CASE WHEN regexp_matches(content, '(?i)Install(?:ation)?[:\\s]+(.+?)(?:\\n|$)') THEN trim(regexp_extract(content, '(?i)Install(?:ation)?[:\\s]+(.+?)(?:\\n|$)', 1)) END AS installation_instructions
FROM d)
SELECT * FROM x""",
)
def enrich_from_text(t):
    empty = F.array().cast("array<string>")
    df = derive(t.documents, ENRICH).withColumns(
        {"supported_os": empty, "categories": empty, "tags": empty}
    )
    out = normalize.enrich_from_text(df, "content", now())
    lists = {c: F.array_join(c, "|") for c in ("supported_os", "categories", "tags")}
    return out.withColumns(lists).drop("content", "last_enriched_by", "last_enriched_at")


@query(
    "content_hash",
    "SELECT doc_id, sha256(lower(trim(text, E' \\t\\n\\r'))) AS content_hash, sha256(text) AS raw_hash FROM documents",
)
def content_hash(t):
    return t.documents.select(
        "doc_id", f.content_hash("text").alias("content_hash"), F.sha2("text", 256).alias("raw_hash")
    )


@query("normalize_parent")
def normalize_parent(t):
    raw = derive(t.part, RAW).drop("part_id", "tags").withColumn("content", F.concat_ws("\n", "description", F.lit("License: X")))
    out = normalize.normalize_parent(raw.withColumn("tags", F.split("categories", ",")), now())
    return out.select("tool_id", "tool_name", "website", "version", "license", "data_quality_score", "quality_rank")


@query(
    "normalized_rank_counts",
    f"""WITH {RAW_CTE},
n AS (SELECT coalesce(nullif(official_site_url, ''), nullif(website, '')) AS website,
 coalesce(nullif(version, ''), nullif(tool_version, '')) AS version,
 coalesce(nullif(license, ''), nullif(licence, '')) AS license, categories, tags FROM raw),
s AS (SELECT round(100.0 * ((website IS NOT NULL)::INT + (version IS NOT NULL)::INT + (license IS NOT NULL)::INT
  + (len(list_filter(string_split(coalesce(categories, ''), ','), lambda x: trim(x) <> '')) > 0)::INT
  + (len(list_filter(string_split(coalesce(tags, ''), ','), lambda x: trim(x) <> '')) > 0)::INT) / 8, 1) AS score FROM n)
SELECT {RANK_SQL} AS quality_rank, count(*) AS n, (SELECT count(*) FROM s) AS total FROM s GROUP BY 1""",
)
def normalized_rank_counts(t):
    out = normalize.normalize_parent(derive(t.part, RAW), now())
    return quality.rank_counts(out)


# ---------------------------------------------------------------- search and logs

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@query(
    "search_page",
    """WITH h AS (SELECT doc_id, lang, source, n_chars FROM documents
 WHERE lang = 'en' AND n_chars >= 200 AND n_chars <= 20000 AND (text ILIKE '%the%' OR source ILIKE '%the%'))
SELECT *, (SELECT count(*) FROM h) AS total FROM (SELECT * FROM h ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50)""",
)
def search_page(t):
    spec = search.SearchSpec(
        columns=DOC_COLUMNS, equals={"lang": "en", "secret": "x"}, at_least={"n_chars": 200},
        at_most={"n_chars": 20000}, text="The", text_columns=("text", "source", "secret"),
        sort="n_chars", descending=True, tie="doc_id", page=2, page_size=50,
    )
    rows, total = search.search(t.documents, spec)
    return rows.drop("text").withColumn("total", total.scalar())


def activity(t):
    return derive(t.events, ACTIVITY)


ACTIVITY = {
    "event_id": "event_id",
    "timestamp": "ts",
    "event_type": "event_type",
    "severity": "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 50 THEN 'WARNING' ELSE 'INFO' END",
    "message": "concat('user ', CAST(user_id AS VARCHAR(20)), ' did ', upper(event_type))",
    "username": "CAST(user_id AS VARCHAR(20))",
    "data": "props",
}
ACTIVITY_CTE = cte("log", "events", ACTIVITY).replace(" AS timestamp", ' AS "timestamp"')


@query(
    "search_log",
    f"""WITH {ACTIVITY_CTE}, h AS (SELECT event_id, event_type, severity, username FROM log
 WHERE severity IN ('ERROR', 'WARNING') AND "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-25 00:00:00'
 AND (lower(message) LIKE '%error%' OR lower(event_type) LIKE '%error%' OR data ILIKE '%error%')
 ORDER BY "timestamp" DESC, event_id DESC)
SELECT event_id, event_type, severity, username, (SELECT count(*) FROM h) AS total FROM h LIMIT 50""",
)
def search_log(t):
    spec = search.LogSpec(
        severity=("ERROR", "WARNING"), start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", text="Error"
    )
    rows, total = search.search_log(activity(t), spec, tie="event_id")
    return rows.select("event_id", "event_type", "severity", "username", total.scalar().alias("total"))


@query(
    "flatten_payload",
    """SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events""",
)
def flatten_payload(t):
    # "event_type" is already a column, so a payload key of that name is left out.
    out = search.flatten_payload(t.events, "props", ["k", "event_type"])
    return out.select("event_id", "event_type", "k")


@query(
    "payload_map",
    """SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 2""",
)
def payload_map(t):
    out = search.payload_map(t.events, "props").select(F.explode("payload").alias("key", "value"))
    return out.groupBy("key", "value").agg(F.count("*").alias("n"))


KNOW = {
    "id": "doc_id", "type": "lang", "source": "source",
    "url": "CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat('http://x/', source) END",
    "timestamp": "doc_id",
}


@query(
    "read_knowledge",
    f"""WITH {cte("k", "documents", KNOW).replace(" AS timestamp", ' AS "timestamp"')}
SELECT id, coalesce(nullif(url, ''), nullif(source, ''), '') AS url FROM k WHERE type = 'en'""",
)
def read_knowledge(t):
    return search.read_knowledge(derive(t.documents, KNOW), "en").select("id", "url")


@query("delete_where", "SELECT event_id FROM events WHERE NOT (event_type = 'error' AND value > 10)")
def delete_where(t):
    test = (F.col("event_type") == "error") & (F.col("value") > 10)
    return search.delete_where(t.events, test).select("event_id")


@query("latest_n", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_n(t):
    return search.latest_n(t.events, "ts", 100, "event_id").select("event_id", "event_type")


@query(
    "latest_per_key",
    """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_per_key(t):
    out = search.latest_per_key(t.events, "user_id", "ts", "event_id")
    return out.select("user_id", "event_id", "event_type", "value")


@query(
    "errors_last_hours",
    "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR",
)
def errors_last_hours(t):
    return search.within_last(t.events.filter("event_type = 'error'"), "ts", now(), 48).select("event_id", "user_id")


@query(
    "updated_since",
    "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01 00:00:00' AND o_orderpriority LIKE '1%'",
)
def updated_since(t):
    since = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    out = search.updated_since(t.orders, "o_orderdate", since, F.col("o_orderpriority").startswith("1"))
    return out.select("o_orderkey")


@query("export_columns", "SELECT p_partkey, p_name, p_size FROM part")
def export(t):
    return export_columns(t.part, ["p_partkey", "p_name", "p_size"], ["p_partkey", "p_name", "p_size", "p_type"])
