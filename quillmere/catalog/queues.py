"""Crawl queue, streaks, parser choice and keyed gates over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl_queue as q
from ..operators import search
from ..streaming import gates, state
from .base import NOW_TEXT, cte, derive, now, query

JOBS = {
    "id": "o_orderkey",
    "tool_name": "concat('Tool ', o_orderpriority)",
    "target_url": "concat('http://', CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'B' END, '.example.com/', CAST(o_custkey AS VARCHAR(20)))",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END",
    "force_recrawl_flag": "o_orderkey % 10 = 0",
    "priority": "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)",
    "focus_score": "CAST(o_custkey % 5 AS DOUBLE) / 4.0",
    "parser_hint": "CASE o_orderkey % 4 WHEN 0 THEN 'wiki' WHEN 1 THEN 'old' WHEN 2 THEN NULL ELSE 'docs' END",
    "last_crawled_at": "o_orderdate",
    "completion_percentage": "0",
}
JOBS_CTE = cte("j", "orders", JOBS)


def jobs(t):
    return derive(t.orders, JOBS)


@query("queue_order", f"WITH {JOBS_CTE} SELECT id, status, focus_score, priority FROM j WHERE status <> 'completed' OR force_recrawl_flag")
def queue_order(t):
    return q.queue_order(jobs(t)).select("id", "status", "focus_score", "priority")


@query(
    "queue_page",
    f"WITH {JOBS_CTE} SELECT id, priority, (SELECT count(*) FROM j) AS total FROM j ORDER BY priority DESC, id LIMIT 100",
)
def queue_page(t):
    return q.queue_page(jobs(t)).select("id", "priority", "total")


@query(
    "latest_job",
    f"WITH {JOBS_CTE} SELECT id, status, target_url FROM j ORDER BY (status IN ('running', 'completed')) DESC, id DESC LIMIT 1",
)
def latest_job(t):
    return q.latest_job(jobs(t)).select("id", "status", "target_url")


@query(
    "queue_transition",
    f"""WITH {JOBS_CTE} SELECT id, CASE WHEN status = 'failed' THEN 'error' ELSE status END AS status, TIMESTAMP '{NOW_TEXT}' AS last_crawled_at,
 CASE WHEN status IN ('failed', 'completed') THEN TIMESTAMP '{NOW_TEXT}' + INTERVAL 90 DAY END AS next_scheduled_crawl_at, FALSE AS force_recrawl_flag FROM j""",
)
def queue_transition(t):
    status = F.when(F.col("status") == "failed", "error").otherwise(F.col("status"))
    out = q.queue_transition(jobs(t), status, F.lit(100), now())
    return out.select("id", "status", "last_crawled_at", "next_scheduled_crawl_at", "force_recrawl_flag")


@query(
    "force_recrawl",
    f"""WITH {JOBS_CTE} SELECT id, CASE WHEN focus_score = 0.75 THEN 'pending' ELSE status END AS status, focus_score = 0.75 OR force_recrawl_flag AS force_recrawl_flag FROM j""",
)
def force_recrawl(t):
    chosen = jobs(t).filter("focus_score = 0.75").select("id")
    return q.force_recrawl(jobs(t), chosen)[0].select("id", "status", "force_recrawl_flag")


CODES = {
    "row_id": "event_id",
    "s": "CASE event_id % 7 WHEN 0 THEN '200' WHEN 1 THEN '200_js_rendered' WHEN 2 THEN 'error_http_404' WHEN 3 THEN 'error_timeout' "
    "WHEN 4 THEN 'error_http_503' WHEN 5 THEN 'disallowed_by_policy' ELSE concat('error_', event_type) END",
}


@query(
    "status_code",
    f"""WITH {cte("d", "events", CODES)} SELECT row_id, coalesce(TRY_CAST(CASE WHEN s LIKE '200%' THEN split_part(s, '_', 1)
 WHEN contains(s, '_') THEN list_last(string_split(s, '_')) END AS INTEGER), 0) AS code FROM d""",
)
def status_code(t):
    return derive(t.events, CODES).select("row_id", q.status_code("s").alias("code"))


@query(
    "crawler_stats",
    f"""WITH {JOBS_CTE} SELECT count(CASE WHEN status IN ('pending', 'running') THEN 1 END) AS queue_size, count(CASE WHEN status = 'running' THEN 1 END) AS running,
 count(*) AS total_jobs, count(CASE WHEN status = 'failed' THEN 1 END) AS total_errors, max(CASE WHEN status = 'failed' THEN id END) AS last_failed_id,
 CASE WHEN count(CASE WHEN status = 'running' THEN 1 END) > 0 THEN 'RUNNING' WHEN count(CASE WHEN status IN ('pending', 'running') THEN 1 END) = 0 THEN 'IDLE' ELSE 'PENDING' END AS system_state FROM j""",
)
def crawler_stats(t):
    return q.crawler_stats(jobs(t))


@query(
    "filter_queue",
    f"""WITH {JOBS_CTE} SELECT id, tool_name FROM j WHERE status = 'pending' AND parser_hint = 'wiki' AND contains(target_url, 'B.example')
 AND (contains(lower(tool_name), 'urgent') OR contains(lower(target_url), 'urgent'))""",
)
def filter_queue(t):
    spec = {"status": "pending", "parser": "wiki", "priority": "", "domain": "B.example", "text": "URGENT"}
    return q.filter_queue(jobs(t), spec).select("id", "tool_name")


@query(
    "recency_counts",
    f"""SELECT count(CASE WHEN ts > TIMESTAMP '{NOW_TEXT}' - INTERVAL 24 HOUR THEN 1 END) AS last_24h,
 count(CASE WHEN ts > TIMESTAMP '{NOW_TEXT}' - INTERVAL 7 DAY THEN 1 END) AS last_7_days, count(*) AS total FROM events""",
)
def recency_counts(t):
    return q.recency_counts(t.events, "ts", now())


STREAK_SQL = """i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN 0 ELSE
 sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) END::BIGINT AS streak FROM i)"""


@query("error_streaks", f"WITH {STREAK_SQL} SELECT event_id, streak FROM s")
def error_streaks(t):
    ok = F.col("event_type") != "error"
    return q.error_streaks(t.events, "user_id", "ts", "event_id", ok).select("event_id", "streak")


@query(
    "until_error_limit",
    f"""WITH {STREAK_SQL}, b AS (SELECT user_id, min((ts, event_id)) AS stop FROM s WHERE streak >= 3 GROUP BY 1)
SELECT event_id, streak FROM s LEFT JOIN b USING (user_id) WHERE stop IS NULL OR (ts, event_id) <= stop""",
)
def until_error_limit(t):
    ok = F.col("event_type") != "error"
    s = q.error_streaks(t.events, "user_id", "ts", "event_id", ok)
    return q.until_error_limit(s, "user_id", "ts", "event_id", 3).select("event_id", "streak")


@query(
    "latest_training",
    "SELECT strftime(arg_max(o_orderdate, (o_orderdate, o_orderkey)), '%Y-%m-%d %H:%M:%S') AS last_time, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS accuracy FROM orders",
)
def latest_training(t):
    runs = t.orders.withColumn("accuracy", F.col("o_totalprice"))
    return q.latest_training(runs, "o_orderdate", "o_orderkey")


REGISTRY = {
    "name": "CASE r_regionkey WHEN 0 THEN 'wiki' WHEN 1 THEN 'docs' WHEN 2 THEN 'old' ELSE r_name END",
    "priority": "CASE r_regionkey WHEN 1 THEN 9 WHEN 2 THEN 50 ELSE r_regionkey END",
    "enabled": "r_regionkey <> 2",
}


@query(
    "choose_parser",
    f"""WITH {JOBS_CTE}, {cte("r", "region", REGISTRY)},
best AS (SELECT name FROM r WHERE enabled ORDER BY priority DESC, name LIMIT 1)
SELECT id, coalesce((SELECT name FROM r WHERE enabled AND name = parser_hint), (SELECT name FROM best)) AS parser FROM j""",
)
def choose_parser(t):
    return q.choose_parser(jobs(t), derive(t.region, REGISTRY)).select("id", "parser")


@query(
    "reorder",
    "SELECT n_name, CAST(CASE n_nationkey WHEN 5 THEN 6 WHEN 6 THEN 5 ELSE n_nationkey END AS INTEGER) AS position FROM nation",
)
def reorder(t):
    df = t.nation.select("n_name", "n_nationkey", F.col("n_nationkey").alias("position"))
    return q.reorder(df, "position", "n_nationkey", 5, 1).select("n_name", "position")


@query(
    "list_positions",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS position FROM customer",
)
def list_positions(t):
    out = q.with_positions(t.customer.select("c_custkey", "c_acctbal"), [F.col("c_acctbal").desc(), "c_custkey"])
    return out.select("c_custkey", "position")


GATE_SQL = """WITH RECURSIVE d AS (SELECT user_id % 10 AS domain, event_id AS seq, ts, event_type <> 'signup' AS robots_ok, to_seconds(3600 * (1 + user_id % 10)) AS wait FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) AS i FROM d),
w AS (SELECT domain, i, ts, seq, robots_ok AS allowed, CASE WHEN robots_ok THEN 'allowed' ELSE 'disallowed_by_robots' END AS reason,
  CASE WHEN robots_ok THEN ts END AS last, CAST(NULL AS TIMESTAMP) AS restricted_until FROM o WHERE i = 1
 UNION ALL
 SELECT o.domain, o.i, o.ts, o.seq, o.robots_ok AND (w.last IS NULL OR o.ts >= w.last + o.wait),
  CASE WHEN o.ts < w.last + o.wait THEN 'crawl_delay' WHEN o.robots_ok THEN 'allowed' ELSE 'disallowed_by_robots' END,
  CASE WHEN o.robots_ok AND (w.last IS NULL OR o.ts >= w.last + o.wait) THEN o.ts ELSE w.last END,
  CASE WHEN o.ts < w.last + o.wait THEN w.last + o.wait END
 FROM w JOIN o ON o.domain = w.domain AND o.i = w.i + 1)
SELECT CAST(domain AS VARCHAR) AS domain, seq, allowed, reason, restricted_until FROM w"""


def gate_requests(t):
    return t.events.select(
        (F.col("user_id") % 10).alias("domain"), F.col("event_id").alias("seq"), "ts",
        (F.col("event_type") != "signup").alias("robots_ok"),
        (3600.0 * (1 + F.col("user_id") % 10)).alias("wait"),
    )


@query("rate_gate", GATE_SQL)
def rate_gate(t):
    out = gates.rate_gate_batch(gate_requests(t), "domain", "ts", "seq", "wait", "robots_ok")
    return out.select("domain", "seq", "allowed", "reason", "restricted_until")


FETCHES = {
    "url": "CAST(user_id AS VARCHAR(20))",
    "seq": "event_id",
    "ts": "ts",
    "status": "CASE event_type WHEN 'error' THEN 'error_http_404' WHEN 'view' THEN '304_not_modified' WHEN 'click' THEN '200_js_rendered' "
    "WHEN 'signup' THEN 'disallowed_by_policy' ELSE '200' END",
    "etag": "CAST(event_id AS VARCHAR(20))",
    "content_hash": "md5(props)",
}


@query(
    "crawl_state",
    f"""WITH f AS (SELECT * FROM ({'SELECT ' + ', '.join(f'{e} AS {c}' for c, e in FETCHES.items()) + ' FROM events'}) WHERE status <> 'disallowed_by_policy'),
i AS (SELECT *, sum(CASE WHEN status LIKE 'error%' THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY ts, seq) AS island FROM f),
s AS (SELECT *, sum(CASE WHEN status LIKE 'error%' THEN 1 ELSE 0 END) OVER (PARTITION BY url, island ORDER BY ts, seq)::BIGINT AS errors FROM i)
SELECT url, arg_max(etag, seq) FILTER (status LIKE '200%') AS etag, arg_max(content_hash, seq) FILTER (status LIKE '200%') AS content_hash,
 coalesce(arg_max(CASE WHEN status LIKE '200%' THEN 200 WHEN status LIKE 'error%' THEN 404 ELSE 0 END, seq) FILTER (status NOT LIKE '304%'), 0) AS http_status,
 arg_max(errors, seq) AS consecutive_errors, max(ts) AS last_crawled_at FROM s GROUP BY url""",
)
def crawl_state(t):
    return state.crawl_state_batch(derive(t.events, FETCHES))


@query(
    "live_counts",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, count(*) AS n
FROM events GROUP BY ALL""",
)
def live_counts(t):
    severity = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return state.live_counts(t.events.withColumn("severity", severity)).drop("end")


@query(
    "feed_newest",
    "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
)
def feed_newest(t):
    return state.newest(t.events, 500, "ts", "event_id").select("event_id", "event_type")


@query(
    "dedup_within",
    "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
)
def dedup_within(t):
    out = state.dedup_within_batch(t.events, ["user_id", "event_type"], "ts", "event_id")
    return out.select("user_id", "event_type", "event_id")


@query(
    "latest_operation_timing",
    "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1",
)
def latest_operation_timing(t):
    out = search.latest_per_key(t.events, "event_type", "ts", "event_id")
    return out.select("event_type", "event_id", "value")
