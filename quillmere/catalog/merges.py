"""Flags, upserts, set operations, graph walks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import authority, join_url
from ..operators import fuzzy, graph, merge
from .base import derive, query

# Two customer tables: the stored one lacks low balances, and the arriving one
# (all segments but one) has changed and new rows.
STORED = "SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer WHERE c_acctbal >= 2000"
ARRIVING_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_name, '!') END AS c_name,
 c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END AS c_mktsegment, c_nationkey
 FROM customer WHERE c_mktsegment <> 'MACHINERY'"""
ARRIVING = {
    "c_custkey": "c_custkey",
    "c_name": "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(c_name, '!') END",
    "c_acctbal": "c_acctbal + 1",
    "c_mktsegment": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'NEW' END",
    "c_nationkey": "c_nationkey",
}


def stored(t):
    cols = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    return t.customer.filter("c_acctbal >= 2000").select(*cols)


def arriving(t):
    return derive(t.customer.filter("c_mktsegment <> 'MACHINERY'"), ARRIVING)


def upsert_oracle(name, balance, segment, nation) -> str:
    return f"""WITH o AS ({STORED}), n AS ({ARRIVING_SQL}),
j AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_custkey IS NOT NULL AS is_old, n.c_custkey IS NOT NULL AS is_new,
 o.c_name AS on_, n.c_name AS nn, o.c_acctbal AS ob, n.c_acctbal AS nb, o.c_mktsegment AS os, n.c_mktsegment AS ns,
 o.c_nationkey AS ok, n.c_nationkey AS nk FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
SELECT c_custkey, {name} AS c_name, {balance} AS c_acctbal, {segment} AS c_mktsegment, {nation} AS c_nationkey,
 CASE WHEN is_new AND is_old THEN 'updated' WHEN is_new THEN 'inserted' ELSE 'unchanged' END AS merge_action FROM j"""


def over(old, new):
    return f"CASE WHEN is_new THEN {new} ELSE {old} END"


@query("upsert_overwrite", upsert_oracle(over("on_", "nn"), over("ob", "nb"), over("os", "ns"), over("ok", "nk")))
def upsert_overwrite(t):
    return merge.upsert(stored(t), arriving(t), "c_custkey", "overwrite")[0]


@query(
    "upsert_keep_first",
    upsert_oracle("coalesce(on_, nn)", "coalesce(ob, nb)", "CASE WHEN is_old THEN os ELSE ns END", "coalesce(ok, nk)").replace(
        "WHEN is_new AND is_old THEN 'updated' WHEN is_new", "WHEN is_new AND NOT is_old"
    ),
)
def upsert_keep_first(t):
    return merge.upsert(stored(t), arriving(t), "c_custkey", "keep_first")[0]


@query(
    "upsert_keep_old_if_blank",
    upsert_oracle("coalesce(nullif(nn, ''), on_)", "coalesce(nb, ob)", "coalesce(nullif(ns, ''), os)", "coalesce(nk, ok)"),
)
def upsert_keep_old_if_blank(t):
    return merge.upsert(stored(t), arriving(t), "c_custkey", "keep_old_if_blank")[0]


@query(
    "upsert_counts",
    f"""WITH o AS ({STORED}), n AS ({ARRIVING_SQL}) SELECT CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN 'updated'
 WHEN n.c_custkey IS NOT NULL THEN 'inserted' ELSE 'unchanged' END AS merge_action, count(*) AS n
FROM o FULL JOIN n ON o.c_custkey = n.c_custkey GROUP BY 1""",
)
def upsert_counts(t):
    return merge.upsert(stored(t), arriving(t), "c_custkey", "overwrite")[1]


@query(
    "upsert_counter",
    """WITH o AS (SELECT user_id, min(value) AS best, count(*) AS errors FROM events WHERE event_type = 'error' AND value > 20 GROUP BY 1),
n AS (SELECT user_id, count(*) AS more, arg_max(value, event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT n.user_id, last AS best, coalesce(errors, 0) + more AS errors FROM n LEFT JOIN o USING (user_id)""",
)
def upsert_counter(t):
    errors = t.events.filter("event_type = 'error'")
    old = errors.filter("value > 20").groupBy("user_id").agg(
        F.min("value").alias("best"), F.count("*").alias("errors")
    )
    fresh = errors.select("user_id", "event_id", F.col("value").alias("best"))
    policy = {"best": "overwrite", "errors": "counter"}
    return merge.upsert(old, fresh, "user_id", policy, ["event_id"])[0].drop("merge_action")


@query(
    "upsert_settings",
    """SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1""",
)
def upsert_settings(t):
    empty = t.spark.createDataFrame([], "key string, value string")
    fresh = t.events.select(F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return merge.upsert(empty, fresh, "key", "overwrite", ["event_id"])[0].drop("merge_action")


@query(
    "duplicate_flag",
    f"""WITH o AS ({STORED}), n AS (SELECT c_custkey + 1 AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name FROM customer)
SELECT n.*, CASE WHEN n.c_custkey IN (SELECT c_custkey FROM o WHERE c_custkey <> 0) OR (n.c_name <> '' AND n.c_name IN (SELECT c_name FROM o)) THEN 'duplicate' ELSE 'unique' END AS dedup FROM n""",
)
def duplicate_flag(t):
    fresh = t.customer.selectExpr(
        "c_custkey + 1 AS c_custkey", "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name"
    )
    return merge.duplicate_flag(fresh, stored(t), ["c_custkey", "c_name"])


LABELLED_DOCS = "doc_id IN (SELECT doc_id FROM labels)"
NULL_LANG = "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END"


@query(
    "exact_match_flag",
    f"""WITH s AS (SELECT DISTINCT source, {NULL_LANG} AS lang, n_chars FROM documents WHERE {LABELLED_DOCS})
SELECT doc_id, EXISTS (SELECT 1 FROM s WHERE s.source = d.source AND s.lang = d.lang AND s.n_chars = d.n_chars) AS strict_match,
 EXISTS (SELECT 1 FROM s WHERE s.source IS NOT DISTINCT FROM d.source AND s.lang IS NOT DISTINCT FROM d.lang AND s.n_chars IS NOT DISTINCT FROM d.n_chars) AS null_safe_match
FROM (SELECT doc_id, source, {NULL_LANG} AS lang, n_chars FROM documents) d""",
)
def exact_match_flag(t):
    d = t.documents.selectExpr("doc_id", "source", f"{NULL_LANG} AS lang", "n_chars")
    s = d.join(t.labels, "doc_id", "left_semi").drop("doc_id")
    out = merge.exact_match_flag(d, s, name="strict_match")
    out = merge.exact_match_flag(out, s, null_safe=True, name="null_safe_match")
    return out.select("doc_id", "strict_match", "null_safe_match")


@query(
    "exclude_seen",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def exclude_seen(t):
    seen = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.exclude_seen(t.orders, seen, "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "import_dedup",
    """WITH n AS (SELECT DISTINCT text, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), s AS (SELECT DISTINCT text, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
a AS (SELECT count(*) AS added FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.text = n.text AND s.source = n.source))
SELECT added, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) - added AS skipped FROM a""",
)
def import_dedup(t):
    fresh = t.documents.join(t.labels, "doc_id", "left_anti")
    old = t.documents.join(t.labels, "doc_id", "left_semi").select("text", "source")
    added = merge.exclude_seen(fresh.dropDuplicates(["text", "source"]), old, ["text", "source"])
    total = fresh.agg(F.count("*")).scalar()
    return added.agg(F.count("*").alias("added")).withColumn("skipped", total - F.col("added"))


DIM = {"os_id": "c_custkey", "os_name": "c_mktsegment",
       "version": "CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE CAST(c_nationkey AS VARCHAR(9)) END"}
NEED = {"supp": "s_suppkey", "os_name": "CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE concat('OS', CAST(s_nationkey AS VARCHAR(9))) END",
        "version": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(s_nationkey AS VARCHAR(9)) END"}


@query(
    "get_or_create_dim",
    f"""WITH dim AS (SELECT {DIM['os_id']} AS os_id, {DIM['os_name']} AS os_name, {DIM['version']} AS version FROM customer WHERE c_acctbal < 1000),
need AS (SELECT {NEED['supp']} AS supp, {NEED['os_name']} AS os_name, {NEED['version']} AS version FROM supplier),
w AS (SELECT DISTINCT os_name, version FROM need),
m AS (SELECT w.os_name, w.version, min(dim.os_id) AS os_id FROM w LEFT JOIN dim ON dim.os_name = w.os_name AND (dim.version = w.version OR dim.version IS NULL) GROUP BY 1, 2),
f AS (SELECT os_name, version, (SELECT max(os_id) FROM dim) + row_number() OVER (ORDER BY os_name NULLS FIRST, version NULLS FIRST) AS os_id FROM m WHERE os_id IS NULL),
u AS (SELECT * FROM m WHERE os_id IS NOT NULL UNION ALL SELECT * FROM f)
SELECT supp, need.os_name, need.version, u.os_id FROM need LEFT JOIN u ON need.os_name IS NOT DISTINCT FROM u.os_name AND need.version IS NOT DISTINCT FROM u.version""",
)
def get_or_create_dim(t):
    dim = derive(t.customer.filter("c_acctbal < 1000"), DIM)
    return merge.get_or_create_dim(derive(t.supplier, NEED), dim, "os_name", "version", "os_id")[0]


@query(
    "consistency",
    """WITH u AS (SELECT text AS id, 'a' AS source, lang, source AS origin, CAST(n_chars AS VARCHAR) AS size FROM documents
 UNION ALL SELECT text, 'b', upper(lang), CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, CAST(n_chars AS VARCHAR) FROM documents),
l AS (SELECT DISTINCT id, source, 'lang' AS field, lang AS value FROM u WHERE lang <> '' UNION SELECT DISTINCT id, source, 'origin', origin FROM u WHERE origin <> ''
 UNION SELECT DISTINCT id, source, 'size', size FROM u WHERE size <> ''),
c AS (SELECT id, field, count(DISTINCT value) AS n_values FROM l GROUP BY 1, 2 HAVING count(DISTINCT value) > 1)
SELECT md5(l.id) AS id, l.field, source, value, n_values FROM l JOIN c ON l.id = c.id AND l.field = c.field""",
)
def consistency(t):
    # Texts stand for themselves by their digest from the start, so that no text is shuffled.
    d = t.documents.withColumn("text", F.md5("text"))
    size = F.col("n_chars").cast("string").alias("size")
    a = d.select(F.col("text").alias("id"), "lang", F.col("source").alias("origin"), size)
    b = d.select(
        F.col("text").alias("id"), F.upper("lang").alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("origin"), size,
    )
    return merge.consistency({"a": a, "b": b}, "id", ["lang", "origin", "size"])


@query(
    "change_audit",
    f"""WITH o AS ({STORED}), n AS ({ARRIVING_SQL}), j AS (SELECT n.c_custkey, o.c_name AS a1, n.c_name AS b1, o.c_mktsegment AS a2, n.c_mktsegment AS b2,
 CAST(o.c_nationkey AS VARCHAR) AS a3, CAST(n.c_nationkey AS VARCHAR) AS b3 FROM o JOIN n ON o.c_custkey = n.c_custkey)
SELECT c_custkey, 'c_name' AS field, a1 AS old_value, b1 AS new_value FROM j WHERE a1 IS DISTINCT FROM b1
UNION ALL SELECT c_custkey, 'c_mktsegment', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2
UNION ALL SELECT c_custkey, 'c_nationkey', a3, b3 FROM j WHERE a3 IS DISTINCT FROM b3""",
)
def change_audit(t):
    return merge.change_audit(stored(t), arriving(t), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query(
    "import_counts",
    "SELECT count(CASE WHEN event_type <> 'error' THEN 1 END) AS success, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(*) AS total FROM events",
)
def import_counts(t):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    return merge.import_counts(t.events.select(status.alias("status")))


@query("single_active", "SELECT n_nationkey, n_nationkey = 7 AS is_active FROM nation")
def single_active(t):
    return merge.single_active(t.nation, "n_nationkey", 7).select("n_nationkey", "is_active")


@query(
    "update_rows",
    """SELECT c.c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' AND c.c_custkey % 5 <> 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_name FROM customer c""",
)
def update_rows(t):
    base = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    return merge.update_rows(base, arriving(t), "c_custkey", ["c_mktsegment"])[0]


@query("update_rows_unknown", "SELECT s_suppkey + 1450 AS c_custkey FROM supplier WHERE s_suppkey + 1450 NOT IN (SELECT c_custkey FROM customer)")
def update_rows_unknown(t):
    updates = t.supplier.select((F.col("s_suppkey") + 1450).alias("c_custkey"), F.lit("X").alias("c_mktsegment"))
    return merge.update_rows(t.customer, updates, "c_custkey", ["c_mktsegment"])[1].select("c_custkey")


@query(
    "union_distinct",
    "SELECT l_returnflag AS flag, l_linestatus AS status FROM lineitem UNION SELECT o_orderstatus, o_orderstatus FROM orders",
)
def union_distinct(t):
    a = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    b = t.orders.select(F.col("o_orderstatus").alias("flag"), F.col("o_orderstatus").alias("status"))
    return merge.union_all(a, b).dropDuplicates()


@query("restrict_to", "SELECT o_orderkey, o_custkey, '{\"a\":\"' || o_orderstatus || '\",\"b\":' || o_orderkey || '}' AS extra FROM orders")
def restrict_to(t):
    nested = F.struct(F.col("o_orderkey").alias("b"), F.col("o_orderstatus").alias("a")).alias("extra")
    df = t.orders.select("o_orderkey", "o_custkey", nested, F.col("o_totalprice").alias("not_there"))
    target = t.spark.createDataFrame([], "o_custkey bigint, extra string, o_orderkey bigint")
    return merge.restrict_to(df, target)


@query(
    "similar_strings",
    """WITH a AS (SELECT DISTINCT lower(s_name) AS v FROM supplier), b AS (SELECT DISTINCT lower(c_name) AS v FROM customer UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT lower(s_name) FROM supplier)
SELECT a.v AS "left", b.v AS "right", round(1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v))::DOUBLE, 9) AS similarity
FROM a JOIN b ON levenshtein(a.v, b.v) <= 0.08 * greatest(length(a.v), length(b.v)) + 1e-9""",
)
def similar_strings(t):
    names = t.supplier.select(F.lower("s_name").alias("v"))
    others = t.customer.select(F.lower("c_name").alias("v")).union(t.part.select(F.lower("p_type"))).union(names)
    return fuzzy.similar_strings(names, others, 0.92).withColumn("similarity", F.round("similarity", 9))


# ------------------------------------------------------------------- graph

HREF_SQL = """links AS (SELECT DISTINCT url AS src, split_part(url, ':', 1) || '://' || split_part(url, '/', 3) || href AS dst
 FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)),
edges AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links)"""


def edges(t):
    """Page to link target and back: the walk goes between pages that share a target."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))
    links = t.pages.select(F.col("url").alias("src"), hrefs.alias("href")).select(
        "src", join_url("src", "href").alias("dst")
    )
    return links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


# Shortest walks from the first page of each host: a level is what the last one reaches anew.
WALK_SQL = f"""WITH RECURSIVE {HREF_SQL},
walk(url, depth) USING KEY (url) AS (SELECT min(url), 0 FROM pages GROUP BY split_part(url, '/', 3)
 UNION SELECT e.dst, min(w.depth) + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE e.dst NOT IN (SELECT url FROM recurring.walk) GROUP BY e.dst)
SELECT url, CAST(depth AS INTEGER) AS depth FROM walk"""


def first_pages(t):
    return t.pages.groupBy(authority("url").alias("host")).agg(F.min("url").alias("url"))


@query("expand_frontier_to_end", WALK_SQL)
def expand_frontier_to_end(t):
    return graph.expand_frontier(edges(t), first_pages(t))


@query(
    "expand_frontier",
    f"""WITH RECURSIVE {HREF_SQL},
walk(url, depth) AS (SELECT min(url), 0 FROM pages GROUP BY split_part(url, '/', 3) UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 6)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""",
)
def expand_frontier(t):
    return graph.expand_frontier(edges(t), first_pages(t), 6)


@query(
    "expand_frontier_capped",
    f"""WITH {HREF_SQL}, d0 AS (SELECT DISTINCT url, 0 AS depth FROM pages),
d1 AS (SELECT DISTINCT dst AS url, 1 AS depth FROM edges JOIN d0 ON src = url WHERE dst NOT IN (SELECT url FROM d0))
SELECT url, depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) ORDER BY depth, url LIMIT 400""",
)
def expand_frontier_capped(t):
    return graph.expand_frontier(edges(t), t.pages.select("url"), 1, 400)


ROBOTS = {
    "domain": "split_part(url, '/', 3)",
    "ordinal": "page_id % 5",
    "agent": "CASE WHEN page_id % 3 = 0 THEN 'otherbot' ELSE '*' END",
    "allow": "page_id % 4 = 0",
    "path": "CASE page_id % 3 WHEN 0 THEN '/en/' WHEN 1 THEN '/fr' ELSE concat('/', split_part(url, '/', 4), '/', substr(split_part(url, '/', 5), 1, 1)) END",
    "crawl_delay": "CASE WHEN page_id % 2 = 0 THEN CAST(page_id % 7 AS INTEGER) ELSE NULL END",
}


@query(
    "robots_verdict",
    f"""WITH r AS (SELECT {", ".join(f"{e} AS {c}" for c, e in ROBOTS.items())} FROM pages),
m AS (SELECT * FROM r WHERE agent = '*'),
u AS (SELECT page_id, url, split_part(url, '/', 3) AS domain, '/' || array_to_string(list_slice(string_split(url, '/'), 4, 99), '/') AS path FROM pages),
v AS (SELECT page_id, arg_min(m.allow, m.ordinal * 2 + m.allow::INT) AS allow FROM u JOIN m ON u.domain = m.domain AND starts_with(u.path, m.path) GROUP BY 1),
h AS (SELECT domain, arg_min(crawl_delay, ordinal * 100 + 50 - crawl_delay) AS d FROM m WHERE crawl_delay IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(v.allow, TRUE) AS allowed, CASE WHEN coalesce(v.allow, TRUE) THEN 'allowed' ELSE 'disallowed_by_robots' END AS reason,
 CAST(coalesce(h.d, 1) AS INTEGER) AS crawl_delay FROM u LEFT JOIN v USING (page_id) LEFT JOIN h USING (domain)""",
)
def robots_verdict(t):
    rules = derive(t.pages, ROBOTS)
    out = graph.robots_verdict(t.pages.select("page_id", "url"), rules, "testbot")
    return out.select("page_id", "allowed", "reason", F.col("crawl_delay").cast("int").alias("crawl_delay"))


ROBOTS_TEXT = {
    "domain": "CAST(page_id AS VARCHAR(20))",
    "text": "concat('# of page', chr(10), 'Disallow: /early', chr(10), 'User-Agent: *', chr(10), 'Disallow: /p', CAST(page_id AS VARCHAR(20)), ' # private', chr(13), chr(10), "
    "'Crawl-delay: ', CAST(page_id % 9 AS VARCHAR(20)), '.5', chr(10), 'Sitemap: http://x/y', chr(10), CASE WHEN page_id % 2 = 0 THEN concat('user-agent: OneBot', chr(10)) ELSE '' END, "
    "'User-agent : TwoBot', chr(10), 'Allow: /a', chr(10), 'Disallow:', chr(10), 'crawl-delay: soon', chr(10), 'User-agent: SlowBot', chr(10), 'Crawl-delay: 7')",
}


@query(
    "robots_rules",
    """WITH a AS (SELECT CAST(page_id AS VARCHAR) AS domain, page_id FROM pages)
SELECT domain, '*' AS agent, FALSE AS allow, '/p' || page_id AS path, page_id % 9 + 0.5::DOUBLE AS crawl_delay FROM a
UNION ALL SELECT domain, unnest(CASE WHEN page_id % 2 = 0 THEN ['onebot', 'twobot'] ELSE ['twobot'] END), TRUE, '/a', NULL FROM a
UNION ALL SELECT domain, unnest(CASE WHEN page_id % 2 = 0 THEN ['onebot', 'twobot'] ELSE ['twobot'] END), TRUE, '/', NULL FROM a
UNION ALL SELECT domain, 'slowbot', TRUE, '/', 7 FROM a""",
)
def robots_rules(t):
    return graph.robots_rules(derive(t.pages, ROBOTS_TEXT)).drop("ordinal")


@query(
    "history_change",
    """WITH h AS (SELECT user_id AS url, arg_max(props, event_id) AS content_hash FROM events WHERE event_type = 'click' AND value > 8 GROUP BY 1)
SELECT event_id, CASE WHEN e.event_type = 'view' THEN 'not_modified' WHEN h.url IS NULL THEN 'new' WHEN h.content_hash = e.props THEN 'unchanged' ELSE 'changed' END AS change_type
FROM events e LEFT JOIN h ON h.url = e.user_id""",
)
def history_change(t):
    e = t.events.select(
        "event_id", F.col("user_id").alias("url"), F.col("props").alias("content_hash"),
        F.when(F.col("event_type") == "view", "304_not_modified").otherwise("200").alias("status"),
    )
    old = t.events.filter("event_type = 'click' and value > 8").groupBy(F.col("user_id").alias("url")).agg(
        F.max_by("props", "event_id").alias("content_hash")
    )
    return graph.history_change(e, old).select("event_id", "change_type")


@query(
    "content_changes",
    """WITH p AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_hash FROM events)
SELECT event_id, previous_hash, CASE WHEN previous_hash IS NULL THEN 'new' WHEN previous_hash = props THEN 'unchanged' ELSE 'changed' END AS change_type FROM p""",
)
def content_changes(t):
    out = graph.content_changes(t.events, "user_id", "ts", "event_id", F.col("props"))
    return out.select("event_id", "previous_hash", "change_type")


@query(
    "containment_join",
    """WITH n AS (SELECT n_nationkey AS ord, n_name AS wanted, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS piece FROM nation),
d AS (SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type || ' for ' || n_name), '[^a-z0-9]', '', 'g') AS core FROM part JOIN nation ON n_nationkey = p_partkey % 25)
SELECT p_partkey, arg_min(n.wanted, n.ord) AS matched FROM d JOIN n ON contains(d.core, n.piece) GROUP BY 1""",
)
def containment_join(t):
    names = t.nation.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("wanted"))
    d = t.part.join(t.nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(
        "p_partkey", F.concat_ws(" ", "p_name", "p_type", F.lit("for"), "n_name").alias("name")
    )
    return graph.containment_join(d, "name", names, "wanted", "ord").select("p_partkey", "matched")


@query(
    "attach_page_id",
    "SELECT min(page_id) OVER (PARTITION BY url) AS page_id, url, md5(html) AS body FROM pages",
)
def attach_page_id(t):
    rows = t.pages.select("url", F.md5("html").alias("body"))
    return graph.attach_page_id(rows, t.pages)


@query(
    "typed_enrichment",
    "SELECT min(page_id) OVER (PARTITION BY url) AS page_id, 'related' AS link_type, url || '#l' AS url, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS description FROM pages",
)
def typed_enrichment(t):
    """Every page has one related link."""
    kind = F.lit("related_links")
    rows = t.pages.select(
        F.col("url").alias("page_url"), kind.alias("kind"), F.lit("related").alias("link_type"),
        F.concat("url", F.lit("#l")).alias("url"),
    )
    return graph.typed_enrichment(rows, t.pages, "related_links")
