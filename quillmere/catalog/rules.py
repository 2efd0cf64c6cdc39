"""Rules, relevance, focus scores, url predicates, verdicts, imports, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import filters, language
from ..plans.flows import curate
from ..runtime import cut_lineage
from ..schemas import RAW_TOOL
from .base import cte, derive, now, query
from .fields import RAW
from .vectors import GREEDY_SQL

RULES = (
    filters.Rule(1, "text", "min_length", "60", priority=2),
    filters.Rule(2, "lang", "blacklist", "DE, it ", priority=1),
    filters.Rule(3, "text", "regex", "[A-Z]", condition="field=text AND field=source", priority=2),
    filters.Rule(4, "source", "unique", "blocked", priority=3),
    filters.Rule(5, "*", "no_exact_match", "stored", priority=3),
    filters.Rule(6, "lang", "blacklist", "en", enabled=False),
    filters.Rule(7, "source", "regex", "src1", condition="field=missing OR field=note", priority=4),
    filters.Rule(8, "source", "regex", "nothing", condition="something else", priority=1),
)


@query(
    "apply_rules",
    """WITH blocked AS (SELECT DISTINCT source FROM documents WHERE source = 'src7'),
stored AS (SELECT DISTINCT lang, source, n_chars FROM documents WHERE n_chars < 100),
v AS (SELECT doc_id, CASE WHEN lower(lang) IN ('de', 'it') THEN 2
 WHEN text <> '' AND length(text) < 60 THEN 1
 WHEN text <> '' AND source <> '' AND NOT regexp_matches(text, '^(?:[A-Z])') THEN 3
 WHEN source IN (SELECT source FROM blocked) THEN 4
 WHEN EXISTS (SELECT 1 FROM stored s WHERE s.lang = d.lang AND s.source = d.source AND s.n_chars = d.n_chars) THEN 5 END AS rule_id FROM documents d)
SELECT doc_id, CASE WHEN rule_id IS NULL THEN 'allowed' ELSE 'filtered' END AS result, rule_id,
 CASE rule_id WHEN 2 THEN 'Field ''lang'' is blacklisted value' WHEN 1 THEN 'Field ''text'' below min length 60'
 WHEN 3 THEN 'Field ''text'' failed regex: [A-Z]' WHEN 4 THEN 'Duplicate value for ''source'''
 WHEN 5 THEN 'Exact duplicate record' ELSE '' END AS reason FROM v""",
)
def apply_rules(t):
    d = t.documents
    tables = {
        "blocked": d.filter("source = 'src7'"),
        "stored": d.filter("n_chars < 100").select("lang", "source", "n_chars"),
    }
    return filters.apply_rules(d, RULES, tables).select("doc_id", "result", "rule_id", "reason")


@query(
    "rule_condition",
    """SELECT doc_id, (text <> '' AND source <> '') AS both_set, FALSE AS unknown_form,
 coalesce(quality <> 0, FALSE) OR coalesce(toxic <> 0, FALSE) AS any_label FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rule_condition(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select(
        "doc_id",
        filters.condition(d, "field=text AND field=source").alias("both_set"),
        filters.condition(d, "text is set").alias("unknown_form"),
        filters.condition(d, "field=quality OR field=toxic").alias("any_label"),
    )


@query(
    "relevance",
    """SELECT doc_id, CAST((CASE WHEN length(text) >= 30 THEN 0.5 ELSE 0 END)
 + (CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'und') THEN 0.5 ELSE 0 END) AS DOUBLE) AS score,
 CASE WHEN length(text) >= 30 OR contains(lower(text), 'the') OR contains(lower(text), 'und') THEN 'high' ELSE 'low' END AS relevance,
 CASE WHEN length(text) >= 30 THEN 'high' ELSE 'low' END AS by_length FROM documents""",
)
def relevance(t):
    words = ("The", "UND")
    return t.documents.select(
        "doc_id",
        filters.relevance_score("text", words).alias("score"),
        filters.relevance("text", words).alias("relevance"),
        filters.relevance("text").alias("by_length"),
    )


FOCUS = urls.FocusConfig(
    keywords=("The", "und"), url_patterns=("/EN/", "page=[0-9]$"),
    domain_whitelist=("the.example.com", "ein.example.com"), domain_blacklist=("und.example.com",),
)
FOCUS_COLUMNS = {
    "page_id": "page_id",
    "url": "url",
    "anchor": "url",
    "meta_text": "html",
    "referrer": "CAST((page_id % 7) - 2 AS DOUBLE) / 2.0",
}


@query(
    "focus_score",
    f"""WITH {cte("d", "pages", FOCUS_COLUMNS)},
s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
 (contains(lower(anchor), 'the') OR contains(lower(anchor), 'und'))::INT AS anchor,
 (regexp_matches(url, '(?i)/en/') OR regexp_matches(url, 'page=[0-9]$'))::INT AS url_hit,
 (contains(lower(meta_text), 'the') OR contains(lower(meta_text), 'und'))::INT AS meta,
 least(greatest(referrer, 0), 1)::DOUBLE AS proximity FROM d),
w AS (SELECT *, CASE WHEN host IN ('the.example.com', 'ein.example.com') THEN 1 WHEN host = 'und.example.com' THEN -1 ELSE 0 END AS domain FROM s)
SELECT page_id, anchor, url_hit, meta, proximity, domain,
 CAST(3 * anchor + 2 * url_hit + meta + proximity + domain AS DOUBLE) AS raw_score,
 round(CAST(3 * anchor + 2 * url_hit + meta + proximity + domain AS DOUBLE) / 8.0, 6) AS norm_score FROM w""",
)
def focus_score(t):
    df = derive(t.pages, FOCUS_COLUMNS)
    s = urls.focus_score("url", "anchor", F.create_map(F.lit("m"), F.col("meta_text")), "referrer", FOCUS)
    out = df.select("page_id", s.alias("s")).select("page_id", "s.*")
    return out.withColumnRenamed("url", "url_hit").withColumn("norm_score", F.round("norm_score", 6))


LINKS = {
    "page_id": "page_id",
    "base": "url",
    "link": "CASE page_id % 6 WHEN 0 THEN concat(url, '.pdf') WHEN 1 THEN concat(url, '.PDF') WHEN 2 THEN 'http://other.example.com/x' "
    "WHEN 3 THEN '/docs/a' WHEN 4 THEN concat(url, '/a.tar.gz') ELSE concat(url, '&b=1') END",
}


@query(
    "follow_link",
    f"""WITH {cte("d", "pages", LINKS)}
SELECT page_id, (regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) IN ('', regexp_extract(base, '^[a-z]+://([^/?#]*)', 1)))
 AND NOT regexp_matches(link, '(\\.pdf|\\.zip|\\.tar\\.gz|\\.jpg|\\.png)$') AS follow FROM d""",
)
def follow_link(t):
    return derive(t.pages, LINKS).select("page_id", urls.follow_link("link", "base").alias("follow"))


@query(
    "url_patterns",
    """SELECT page_id, (regexp_matches(url, '/en/') OR regexp_matches(url, '/fr/')) AND NOT regexp_matches(url, 'page=[13]') AS picked,
 NOT regexp_matches(url, 'page=[13]') AS not_excluded FROM pages""",
)
def url_patterns(t):
    return t.pages.select(
        "page_id",
        urls.url_patterns("url", ["/en/", "/fr/"], ["page=[13]"]).alias("picked"),
        urls.url_patterns("url", [], ["page=[13]"]).alias("not_excluded"),
    )


VERDICT_SQL = f"""WITH near AS (SELECT * FROM ({GREEDY_SQL})),
v AS (SELECT d.doc_id, length(d.text) BETWEEN 1 AND 59 AS short, d.source = 'src7' AS known, coalesce(NOT near.kept, FALSE) AS copy,
 (CASE WHEN length(coalesce(d.text, '')) >= {filters.MIN_RELEVANT_LENGTH} THEN 0.5 ELSE 0 END) + (CASE WHEN lower(coalesce(d.text, '')) LIKE '%the%' THEN 0.5 ELSE 0 END) < 0.5 AS low
 FROM documents d LEFT JOIN near USING (doc_id))
SELECT doc_id, CASE WHEN short THEN 'filtered' ELSE 'allowed' END AS result, CASE WHEN short THEN 'Field ''text'' below min length 60' ELSE '' END AS reason,
 CASE WHEN short THEN 1 END AS rule_id, CASE WHEN known THEN 'duplicate' ELSE 'unique' END AS dedup,
 CASE WHEN copy THEN 'near-duplicate' ELSE 'not-near-duplicate' END AS fuzzy, CASE WHEN low THEN 'low' ELSE 'high' END AS relevance,
 CASE WHEN short THEN 'Field ''text'' below min length 60' WHEN known THEN 'duplicate' WHEN copy THEN 'near-duplicate' WHEN low THEN 'low relevance' END AS quarantine_reason
FROM v"""


@query("filter_verdicts", VERDICT_SQL)
def filter_verdicts(t):
    d = t.documents
    rules = [filters.Rule(1, "text", "min_length", "60")]
    stored = d.filter("source = 'src7'").select("doc_id", "text", "source")
    _, _, audit = filters.filter_records(
        d, rules, stored, id_col="doc_id", text_col="text", key_cols=["doc_id"], keywords=["the"]
    )
    return audit


IMPORTS = {
    "rule_key": "p_partkey",
    "name": "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END",
    "description": "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE NULL END",
    "priority": "CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE NULL END",
    "enabled": "CASE WHEN p_partkey % 5 = 0 THEN FALSE ELSE NULL END",
}


@query(
    "import_rules",
    f"""WITH {cte("d", "part", IMPORTS)}
SELECT rule_key, name, coalesce(description, name) AS description, coalesce(priority, 1) AS priority,
 coalesce(enabled, TRUE) AS enabled, CASE WHEN coalesce(name, '') <> '' THEN 'success' ELSE 'failed' END AS status FROM d""",
)
def import_rules(t):
    defaults = {"enabled": True, "priority": 1, "description": "=name"}
    good, bad = filters.import_rules(derive(t.part, IMPORTS), defaults, ["name"])
    return good.unionByName(bad)


ITEMS = {
    "item_id": "event_id",
    "value": "value",
    "specific_source_url": "CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('http://v/', CAST(user_id AS VARCHAR(20))) END",
    "title": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('About ', event_type, ' things') END",
    "description_snippet": "CASE WHEN event_id % 3 = 0 THEN concat('a ', upper(event_type)) ELSE 'views of clicks' END",
    "entity_name": "CASE WHEN user_id % 2 = 0 THEN 'click' WHEN user_id % 3 = 0 THEN 'error' ELSE 'view' END",
    "entity_description": "''",
    "extraction_confidence": "CAST(event_id % 10 AS DOUBLE) / 10.0",
    "language": "CASE WHEN event_id % 7 = 0 THEN 'de' WHEN event_id % 7 = 1 THEN NULL ELSE 'en' END",
}


@query(
    "route_enrichment",
    f"""WITH {cte("d", "events", ITEMS)},
k AS (SELECT DISTINCT specific_source_url FROM d WHERE value > 95 AND specific_source_url <> '')
SELECT item_id, CASE WHEN coalesce(specific_source_url, '') = '' THEN 'invalid_schema'
 WHEN specific_source_url IN (SELECT * FROM k) THEN 'duplicate'
 WHEN language <> 'en' THEN 'non_english'
 WHEN NOT list_contains(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(description_snippet, '')), '[^a-z]+'), entity_name) THEN 'irrelevant'
 WHEN extraction_confidence < 0.6 THEN 'review' ELSE 'inserted' END AS outcome FROM d""",
)
def route_enrichment(t):
    d = derive(t.events, ITEMS)
    known = d.filter("value > 95 and specific_source_url <> ''").select("specific_source_url")
    return filters.route_enrichment(d, known, language="language").select("item_id", "outcome")


LANGUAGE_SQL = r"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents),
cut AS (SELECT w, substr(' ' || w || ' ', s, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) + 1)) AS s FROM (SELECT DISTINCT w FROM w))),
g AS (SELECT lang, gram, sum(n) AS n FROM (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL) JOIN cut USING (w) GROUP BY ALL),
p AS (SELECT lang, gram, ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + 1)) AS weight FROM g),
v AS (SELECT w, lang, sum(weight - (SELECT min(weight) - 2 FROM p)) AS gain FROM cut JOIN p USING (gram) GROUP BY ALL),
s AS (SELECT doc_id, v.lang, sum(gain) AS gain FROM w JOIN v USING (w) GROUP BY ALL),
d AS (SELECT doc_id, arg_max(lang, (gain, lang)) AS detected FROM s GROUP BY 1)
SELECT doc_id, lang, detected, length(coalesce(text, '')) < 8 OR detected IS NULL OR detected = 'en' AS passes
FROM documents LEFT JOIN d USING (doc_id)"""


@query("language_gate", LANGUAGE_SQL)
def language_gate(t):
    profiles = cut_lineage(language.train_language_profiles(t.documents, "text", "lang"), "profiles")
    out = language.language_gate(t.documents, "doc_id", "text", profiles)
    return out.select("doc_id", "lang", "detected", "passes")


@query("curated_tools")
def curated_tools(t):
    raw = derive(t.part, RAW).drop("tags")
    raw = raw.withColumn("content", F.col("description"))
    stored = t.spark.createDataFrame([], RAW_TOOL).select(
        "tool_id", "tool_name", "description", "website", "version", "license"
    )
    rules = [filters.Rule(1, "description", "min_length", "10"), filters.Rule(2, "license", "blacklist", "gpl")]
    return curate(raw, stored, rules, now(), order="part_id").audit
