"""Port and scan risk, distributions and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, risk, rollup
from ..plans.flows import scan_report
from .base import cte, derive, query

PORTS = {
    "row_id": "l_orderkey * 10 + l_linenumber",
    "ip": "l_suppkey",
    "port": "CASE l_partkey % 16 WHEN 0 THEN 21 WHEN 1 THEN 22 WHEN 2 THEN 23 WHEN 3 THEN 25 WHEN 4 THEN 80 WHEN 5 THEN 443 "
    "WHEN 6 THEN 3306 WHEN 7 THEN 3389 WHEN 8 THEN 5432 WHEN 9 THEN 27017 WHEN 10 THEN 6379 WHEN 11 THEN 9200 ELSE CAST(l_partkey % 1000 AS INTEGER) END",
    "service": "CASE l_partkey % 15 WHEN 0 THEN 'FTP' WHEN 1 THEN 'telnet' WHEN 2 THEN 'smtp' WHEN 3 THEN 'http' WHEN 4 THEN 'https' "
    "WHEN 5 THEN 'ssh' WHEN 6 THEN 'rdp' WHEN 7 THEN 'vnc' WHEN 8 THEN 'mysql' WHEN 9 THEN 'postgresql' WHEN 10 THEN 'mongodb' "
    "WHEN 11 THEN 'redis' WHEN 12 THEN 'elasticsearch' ELSE 'other' END",
    "product": "l_returnflag",
    "state": "CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END",
    "version": "CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN '2.0.1' WHEN 3 THEN '7-BETA' WHEN 4 THEN '9.9' WHEN 5 THEN NULL ELSE concat('8.', CAST(l_linenumber AS VARCHAR(9))) END",
    "risk_score": "l_discount * 10.0",
    "is_anomaly": "l_tax > 0.06",
    "anomaly_score": "l_tax",
}
PORTS_CTE = cte("p", "lineitem", PORTS)
RISK_TABLE = (
    "CASE lower(service) WHEN 'ftp' THEN 0.8 WHEN 'telnet' THEN 0.9 WHEN 'smtp' THEN 0.7 WHEN 'http' THEN 0.6 WHEN 'https' THEN 0.5 "
    "WHEN 'ssh' THEN 0.4 WHEN 'rdp' THEN 0.8 WHEN 'vnc' THEN 0.8 WHEN 'mysql' THEN 0.7 WHEN 'postgresql' THEN 0.7 WHEN 'mongodb' THEN 0.7 "
    "WHEN 'redis' THEN 0.7 WHEN 'elasticsearch' THEN 0.7 ELSE 0.3 END"
)
PORT_TABLE = (
    "CASE port WHEN 21 THEN 0.8 WHEN 22 THEN 0.4 WHEN 23 THEN 0.9 WHEN 25 THEN 0.7 WHEN 80 THEN 0.6 WHEN 443 THEN 0.5 WHEN 3306 THEN 0.7 "
    "WHEN 3389 THEN 0.8 WHEN 5432 THEN 0.7 WHEN 27017 THEN 0.7 WHEN 6379 THEN 0.7 WHEN 9200 THEN 0.7 ELSE 0.3 END"
)


def ports(t):
    return derive(t.lineitem, PORTS)


@query(
    "risk_lookups",
    f"""WITH {PORTS_CTE} SELECT service, port, coalesce(version, '-') AS version, CAST({RISK_TABLE} AS DOUBLE) AS service_risk, CAST({PORT_TABLE} AS DOUBLE) AS port_risk,
 CAST(CASE WHEN coalesce(version, '') = '' THEN 0.5 WHEN regexp_matches(version, '[1-5]\\.0') THEN 0.8
 WHEN regexp_matches(lower(version), 'dev|alpha|beta|rc') THEN 0.7 ELSE 0.4 END AS DOUBLE) AS version_risk, count(*) AS n FROM p GROUP BY ALL""",
)
def risk_lookups(t):
    out = risk.risk_lookups(ports(t))
    return out.groupBy(
        "service", "port", F.coalesce("version", F.lit("-")).alias("version"),
        "service_risk", "port_risk", "version_risk",
    ).agg(F.count("*").alias("n"))


@query(
    "high_risk",
    f"""WITH {PORTS_CTE} SELECT 'stats' AS view, count(CASE WHEN risk_score > 0.7 THEN 1 END) AS n FROM p
UNION ALL SELECT 'cli', count(CASE WHEN risk_score >= 0.7 THEN 1 END) FROM p
UNION ALL SELECT 'gui', count(CASE WHEN risk_score > 0.5 OR is_anomaly THEN 1 END) FROM p""",
)
def high_risk(t):
    p = ports(t)
    views = {
        "stats": risk.high_risk(p, 0.7), "cli": risk.high_risk(p, 0.7, inclusive=True),
        "gui": risk.high_risk(p, 0.5, or_anomaly=True),
    }
    parts = [v.agg(F.count("*").alias("n")).select(F.lit(k).alias("view"), "n") for k, v in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "scan_summary",
    f"""WITH {PORTS_CTE} SELECT count(DISTINCT ip) AS total_hosts, count(*) AS total_ports, count(CASE WHEN state = 'open' THEN 1 END) AS open_ports,
 count(CASE WHEN is_anomaly THEN 1 END) AS anomalies, round(avg(risk_score), 6) AS avg_risk, count(CASE WHEN risk_score > 0.7 THEN 1 END) AS high_risk_ports FROM p""",
)
def scan_summary(t):
    return risk.scan_summary(ports(t)).withColumn("avg_risk", F.round("avg_risk", 6))


@query("mean_by_service", f"WITH {PORTS_CTE} SELECT service, round(avg(risk_score), 6) AS mean_risk FROM p GROUP BY 1")
def mean_by_service(t):
    return risk.mean_by(ports(t), "service", "risk_score", "mean_risk").withColumn("mean_risk", F.round("mean_risk", 6))


@query(
    "host_rollup",
    f"WITH {PORTS_CTE} SELECT ip, round(avg(risk_score), 6) AS mean_risk, count(CASE WHEN state = 'open' THEN 1 END) AS open_ports FROM p GROUP BY 1",
)
def host_rollup(t):
    return risk.host_rollup(ports(t)).withColumn("mean_risk", F.round("mean_risk", 6))


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin FROM lineitem, s),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 20.0), 6) AS lower, round(lo + (i + 1) * ((hi - lo) / 20.0), 6) AS upper, coalesce(n, 0) AS n
FROM range(20) r(i) CROSS JOIN s LEFT JOIN c ON c.bin = i""",
)
def histogram(t):
    out = risk.histogram(t.lineitem, "l_extendedprice", 20)
    return out.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("service_counts", f"WITH {PORTS_CTE} SELECT service, count(*) AS n FROM p GROUP BY 1")
def service_counts(t):
    return risk.count_by(ports(t), "service").orderBy(F.col("n").desc(), "service")


@query(
    "count_by_variants",
    f"""WITH {PORTS_CTE} SELECT 'kept' AS kind, version, count(*) AS n FROM p GROUP BY 2
UNION ALL SELECT 'renamed', coalesce(version, 'unknown'), count(*) FROM p GROUP BY 2
UNION ALL SELECT 'skipped', version, count(*) FROM p WHERE version <> '' GROUP BY 2""",
)
def count_by_variants(t):
    p = ports(t)
    kinds = {
        "kept": risk.count_by(p, "version"), "renamed": risk.count_by(p, "version", null_as="unknown"),
        "skipped": risk.count_by(p, "version", skip_empty=True),
    }
    parts = [df.select(F.lit(k).alias("kind"), "version", "n") for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "box_stats",
    f"""WITH {PORTS_CTE}, q AS (SELECT l_returnflag || l_linestatus AS service, l_extendedprice AS x FROM lineitem)
SELECT service, min(x) AS lowest, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median,
 round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS highest, count(*) AS n FROM q GROUP BY 1""",
)
def box_stats(t):
    p = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("service"), F.col("l_extendedprice").alias("x"))
    out = risk.box_stats(p, "service", "x")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("box_stats_approx")
def box_stats_approx(t):
    return risk.box_stats_approx(t.lineitem, "l_returnflag", "l_extendedprice")


@query("version_counts", f"WITH {PORTS_CTE} SELECT service, version, count(*) AS n FROM p WHERE version <> '' GROUP BY 1, 2")
def version_counts(t):
    return risk.version_counts(ports(t))


@query("incidence", f"WITH {PORTS_CTE} SELECT DISTINCT ip, port FROM p WHERE state = 'open'")
def incidence(t):
    return risk.incidence(ports(t).filter("state = 'open'"), "ip", "port")


@query(
    "incidence_matrix",
    f"""WITH {PORTS_CTE} SELECT ip, max((port = 22)::INT) AS port_22, max((port = 80)::INT) AS port_80, max((port = 443)::INT) AS port_443
FROM p WHERE state = 'open' GROUP BY 1""",
)
def incidence_matrix(t):
    open_ports = ports(t).filter("state = 'open'")
    return risk.incidence_matrix(open_ports, "ip", "port", [22, 80, 443])


@query(
    "anomaly_split",
    f"""WITH {PORTS_CTE} SELECT is_anomaly, count(*) AS n, round(avg(anomaly_score), 6) AS mean_score, max(anomaly_score) AS max_score,
 round(avg(risk_score), 6) AS mean_risk FROM p GROUP BY 1""",
)
def anomaly_split(t):
    out = risk.anomaly_split(ports(t))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_risk")})


@query(
    "top_risk_ports",
    f"WITH {PORTS_CTE} SELECT row_id, ip, port, risk_score FROM p ORDER BY risk_score DESC, port, ip, row_id LIMIT 10",
)
def top_risk_ports(t):
    return risk.top_n(ports(t), "risk_score", ["port", "ip", "row_id"]).select("row_id", "ip", "port", "risk_score")


@query(
    "scan_report_rows",
    f"""WITH {PORTS_CTE} SELECT 'services' AS part, count(DISTINCT service) AS n FROM p UNION ALL SELECT 'hosts', count(DISTINCT ip) FROM p
UNION ALL SELECT 'histogram', 20 UNION ALL SELECT 'boxes', count(DISTINCT service) FROM p UNION ALL SELECT 'top', 10
UNION ALL SELECT 'open_ports', count(*) FROM (SELECT DISTINCT ip, port FROM p WHERE state = 'open')""",
)
def scan_report_rows(t):
    report = scan_report(ports(t))
    out = None
    for part in ("services", "hosts", "histogram", "boxes", "top", "open_ports"):
        row = report[part].agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "port_features",
    f"""WITH {PORTS_CTE}, s AS (SELECT service, dense_rank() OVER (ORDER BY service) - 1 AS c FROM (SELECT DISTINCT service FROM p)),
r AS (SELECT product, dense_rank() OVER (ORDER BY product) - 1 AS c FROM (SELECT DISTINCT product FROM p))
SELECT row_id, round(port / 65535.0, 8) AS f_port, round(s.c / (SELECT count(*) FROM s)::DOUBLE, 8) AS f_service,
 round(r.c / (SELECT count(*) FROM r)::DOUBLE, 8) AS f_product, CASE WHEN state = 'open' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_open,
 round(length(coalesce(version, '')) / 100.0::DOUBLE, 8) AS f_version FROM p JOIN s USING (service) JOIN r USING (product)""",
)
def port_features(t):
    out = models.port_features(ports(t))
    return out.select("row_id", *[F.round(c, 8).alias(c) for c in models.PORT_FEATURES])


# ------------------------------------------------------------------- roll-ups


@query(
    "confusion",
    """WITH d AS (SELECT least(n_chars / 4000.0, 1.0) AS p, quality AS label FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(CASE WHEN p >= 0.5 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN p >= 0.5 AND label <> 1 THEN 1 END) AS fp,
 count(CASE WHEN p < 0.5 AND label <> 1 THEN 1 END) AS tn, count(CASE WHEN p < 0.5 AND label = 1 THEN 1 END) AS fn FROM d)
SELECT *, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM c""",
)
def confusion(t):
    d = t.documents.join(t.labels, "doc_id").select(
        F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"), F.col("quality").alias("label")
    )
    return rollup.confusion(d, "p", "label")


@query(
    "dim_stats",
    """WITH u AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 8) AS mean, round(stddev_pop(x) + 1e-8, 8) AS std FROM u GROUP BY 1""",
)
def dim_stats(t):
    out = rollup.dim_stats(t.embeddings, "embedding")
    return out.withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query(
    "mean_median",
    """WITH o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT round(avg(n_chars), 6) AS mean, max(CASE WHEN i = n // 2 THEN n_chars END) AS median, max(n) AS n FROM o""",
)
def mean_median(t):
    return rollup.mean_median(t.documents, "n_chars").withColumn("mean", F.round("mean", 6))


@query(
    "mean_pairwise_l2",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
d AS (SELECT list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT (SELECT count(*) FROM v) AS n_vectors, round(avg(d * d), 8) AS mean_l2 FROM d""",
)
def mean_pairwise_l2(t):
    return rollup.mean_pairwise_l2(t.embeddings, "embedding").withColumn("mean_l2", F.round("mean_l2", 8))


PROJECT_FILES = {
    "category": "concat('cat', CAST(p_size % 7 AS VARCHAR(9)))",
    "project": "p_brand",
    "subproject": "CASE WHEN p_partkey % 2 = 0 THEN concat('sub', CAST(p_partkey AS VARCHAR(20))) ELSE NULL END",
    "file": "CASE WHEN p_partkey % 2 = 1 THEN concat('f', CAST(p_partkey AS VARCHAR(20))) ELSE NULL END",
    "language": "CASE p_partkey % 6 WHEN 1 THEN 'Python' WHEN 3 THEN 'C++' ELSE NULL END",
    "is_knowledge": "p_partkey % 6 = 5",
}


@query(
    "project_rollup",
    f"""WITH {cte("f", "part", PROJECT_FILES)},
g AS (SELECT category, project, count(language) AS code, count(CASE WHEN is_knowledge THEN 1 END) AS know,
 array_to_string(list_sort(list_distinct(list(language) FILTER (language IS NOT NULL))), ', ') AS langs,
 array_to_string(list_slice(list_sort(list_distinct(list(subproject) FILTER (subproject IS NOT NULL))), 1, 10), ', ') AS subs FROM f GROUP BY 1, 2),
c AS (SELECT category, count(*) AS np, sum(code)::BIGINT AS nc, sum(know)::BIGINT AS nk FROM g GROUP BY 1)
SELECT 'documentation' AS type, category, project, file, NULL AS languages, NULL AS subprojects, NULL AS n_code, NULL AS n_knowledge, NULL AS n_projects, NULL AS n_categories, NULL AS n_entries FROM f WHERE is_knowledge
UNION ALL SELECT 'project', category, project, NULL, coalesce(langs, ''), coalesce(subs, ''), code, know, NULL, NULL, NULL FROM g
UNION ALL SELECT 'category', category, NULL, NULL, NULL, NULL, nc, nk, np, NULL, np + nk + 1 FROM c
UNION ALL SELECT 'ecosystem', NULL, NULL, NULL, NULL, NULL, sum(nc)::BIGINT, sum(nk)::BIGINT, sum(np)::BIGINT, count(*), sum(np + nk + 1)::BIGINT FROM c""",
)
def project_rollup(t):
    out = rollup.project_rollup(derive(t.part, PROJECT_FILES))
    return out.withColumns({c: F.array_join(c, ", ") for c in ("languages", "subprojects")})


@query(
    "grouped_levels",
    """SELECT r_name AS region, n_name AS nation, CAST(grouping_id(r_name, n_name) AS INTEGER) AS level, count(*) AS n, round(sum(c_acctbal), 2) AS total
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
def grouped_levels(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "c_acctbal")
    return rollup.grouped_levels(df, "region", "nation", "c_acctbal").withColumn("total", F.round("total", 2))


@query(
    "scan_training_stats",
    f"""WITH {PORTS_CTE} SELECT ip % 10 AS scan, count(DISTINCT ip) AS total_hosts, count(*) AS total_ports,
 count(CASE WHEN state = 'open' THEN 1 END) AS open_ports FROM p GROUP BY 1""",
)
def scan_training_stats(t):
    return ports(t).groupBy((F.col("ip") % 10).alias("scan")).agg(
        F.count_distinct("ip").alias("total_hosts"), F.count("*").alias("total_ports"),
        F.count_if(F.col("state") == "open").alias("open_ports"),
    )
