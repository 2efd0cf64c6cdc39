"""Streams run over whole tables, sources and sinks written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, graph
from ..operators.near_index import NearIndex
from ..runtime import ROCKSDB_PROVIDER, scratch_path
from ..sources import io
from ..streaming import gates, sinks, state
from .base import cte, derive, query
from .merges import WALK_SQL, edges, first_pages
from .queues import FETCHES, GATE_SQL
from .vectors import GREEDY_SQL, SIMHASH_SQL, simhash_sql


def drain(t, stream, label: str):
    """Run a stream to its end into a table of the shared folder and read that."""
    conf = t.spark.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    root = scratch_path(t.spark, label)
    schema = stream.schema
    # State partitions are fixed for a stream's life: no more than two per core.
    usual = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", min(int(usual), 2 * t.spark.sparkContext.defaultParallelism))
    try:
        sinks.run_resumable(stream, f"{root}/checkpoint", f"{root}/out").awaitTermination()
    finally:
        conf.set("spark.sql.shuffle.partitions", usual)
    return t.spark.read.schema(schema).parquet(f"{root}/out")


def source(t, name: str):
    return io.stream_table(t.spark, t.base, name)


@query("stream_rate_gate", GATE_SQL)
def stream_rate_gate(t):
    requests = source(t, "events").select(
        (F.col("user_id") % 10).alias("domain"), F.col("event_id").alias("seq"), "ts",
        (F.col("event_type") != "signup").alias("robots_ok"),
        (3600.0 * (1 + F.col("user_id") % 10)).alias("wait"),
    )
    out = gates.rate_gate(requests, "domain", "ts", "seq", "wait", "robots_ok")
    return drain(t, out, "gate").select("domain", "seq", "allowed", "reason", "restricted_until")


@query(
    "stream_crawl_state",
    f"""WITH f AS (SELECT * FROM ({'SELECT ' + ', '.join(f'{e} AS {c}' for c, e in FETCHES.items()) + ' FROM events'}) WHERE status <> 'disallowed_by_policy'),
i AS (SELECT *, sum(CASE WHEN status LIKE 'error%' THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY ts, seq) AS island FROM f)
SELECT url, seq, coalesce(last_value(CASE WHEN status LIKE '200%' THEN 200 WHEN status LIKE 'error%' THEN 404 END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, seq), 0) AS http_status,
 sum(CASE WHEN status LIKE 'error%' THEN 1 ELSE 0 END) OVER (PARTITION BY url, island ORDER BY ts, seq)::BIGINT AS consecutive_errors,
 last_value(CASE WHEN status LIKE '200%' THEN content_hash END IGNORE NULLS) OVER (PARTITION BY url ORDER BY ts, seq) AS content_hash FROM i""",
)
def stream_crawl_state(t):
    fetches = derive(source(t, "events"), FETCHES)
    out = drain(t, state.crawl_state(fetches), "crawl")
    return out.select("url", "seq", "http_status", "consecutive_errors", "content_hash")


@query(
    "stream_live_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_live_counts(t):
    severity = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    # Event time needs an instant; the table's wall times are read as UTC.
    rows = source(t, "events").withColumn("severity", severity).withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(t, state.live_counts(rows), "counts")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "severity", "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    rows = source(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = state.dedup_within(rows, ["user_id", "event_type"], "ts", "60 days")
    return drain(t, out, "dedup").select("user_id", "event_type")


# A fold along each key: a row is served from what was kept, or keeps its own value.
TTL_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id::VARCHAR AS key, event_id AS seq, ts, props AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT key, i, seq, ts AS at, value, FALSE AS hit FROM e WHERE i = 1
 UNION ALL SELECT e.key, e.i, e.seq, CASE WHEN x.hit THEN w.at ELSE e.ts END, CASE WHEN x.hit THEN w.value ELSE e.value END, x.hit
 FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1, LATERAL (SELECT e.ts - w.at <= INTERVAL 5 DAY AS hit) x)
SELECT key, seq, value, hit FROM w"""


@query("stream_ttl_cache", TTL_SQL)
def stream_ttl_cache(t):
    """Keys come back after five days or sooner, so some are served and some have expired."""
    return drain(t, state.ttl_cache(source(t, "events"), "user_id", "props", "ts", "event_id", 5 * 86_400), "cache")


LRU = {"cache": "event_type", "key": "user_id % 40", "value": "props", "ts": "ts", "seq": "event_id"}


@query(
    "stream_lru_cache",
    f"""WITH RECURSIVE {cte("d", "events", LRU)},
o AS (SELECT cache, key::VARCHAR AS key, value, ts, seq, row_number() OVER (PARTITION BY cache ORDER BY ts, seq) AS pos, row_number() OVER (PARTITION BY cache, key ORDER BY ts, seq) AS i FROM d),
r AS MATERIALIZED (SELECT *, lag(pos) OVER (PARTITION BY cache, key ORDER BY i) AS before FROM o),
e AS MATERIALIZED (SELECT *, (SELECT count(DISTINCT b.key) FROM r b WHERE b.cache = a.cache AND b.pos > a.before AND b.pos < a.pos) < 16 AS present FROM r a),
w AS (SELECT cache, key, i, seq, ts AS at, value, FALSE AS hit FROM e WHERE i = 1
 UNION ALL SELECT e.cache, e.key, e.i, e.seq, CASE WHEN x.hit THEN w.at ELSE e.ts END, CASE WHEN x.hit THEN w.value ELSE e.value END, x.hit
 FROM w JOIN e ON e.cache = w.cache AND e.key = w.key AND e.i = w.i + 1, LATERAL (SELECT e.present AND e.ts - w.at < INTERVAL 6 HOUR AS hit) x)
SELECT cache, key, seq, value, hit FROM w""",
)
def stream_lru_cache(t):
    """Forty keys compete for the sixteen places of each cache for six hours at most."""
    return drain(t, state.lru_cache(derive(source(t, "events"), LRU), "cache", "key", "value", "ts", "seq", 16, 6 * 3600), "lru")


@query(
    "stream_feed",
    "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
)
def stream_feed(t):
    root = scratch_path(t.spark, "feed")
    table = sinks.VersionedTable(t.spark, f"{root}/table", "event_id bigint, ts timestamp_ntz, event_type string")
    sink = state.feed_sink(table, 500, "ts", "event_id")
    sinks.run_resumable(source(t, "events"), f"{root}/checkpoint", each_batch=sink).awaitTermination()
    return table.read().select("event_id", "event_type")


@query(
    "stream_upsert",
    "SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*) AS hits FROM events GROUP BY 1",
)
def stream_upsert(t):
    root = scratch_path(t.spark, "upsert")
    schema = "user_id bigint, last_type string, hits bigint"
    table = sinks.BucketedTable(t.spark, f"{root}/table", schema, "user_id", 8)
    rows = source(t, "events").select("user_id", F.col("event_type").alias("last_type"), "event_id")
    sink = sinks.upsert_sink(table, "user_id", {"last_type": "overwrite", "hits": "counter"}, ["event_id"])
    sinks.run_resumable(rows, f"{root}/checkpoint", each_batch=sink).awaitTermination()
    return table.read()


FILE_ROWS = 10_000  # rows of a file of a batch, at least


def batch_files(rows) -> int:
    """Files for each of four batches: one for so many rows, far more than there are tasks that deal them."""
    return max(1, rows.count() // (4 * FILE_ROWS))


@query("stream_near_dups", GREEDY_SQL)
def stream_near_dups(t):
    """All documents in four batches by id, each against what the earlier ones stored: the one-pass answer."""
    root = scratch_path(t.spark, "near")
    rows = t.documents.select("doc_id", "text")
    cuts = rows.approxQuantile("doc_id", [0.25, 0.5, 0.75], 0.01)
    # As many files in each batch, dealt in turn, so that none is empty: no task reads a batch alone.
    files = batch_files(rows)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        # A stream of files takes the oldest first; each batch is written after the one before.
        late = F.lit(True) if low is None else F.col("doc_id") > low
        rows.filter(late & (F.lit(True) if high is None else F.col("doc_id") <= high)).repartition(files).write.mode("append").parquet(f"{root}/in")
    index = NearIndex(t.spark, f"{root}/index")
    sink = sinks.near_dup_sink(index, f"{root}/out", "doc_id", "text", "doc_id")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    sinks.run_resumable(stream, f"{root}/checkpoint", each_batch=sink).awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("doc_id", "kept", "near_dup_of")


INDEXED_SQL = f"""WITH RECURSIVE {SIMHASH_SQL},
turns AS (SELECT conv_id * 10000 + turn AS id, text FROM conversations),
{simhash_sql("turns", "id", "t")},
hit AS (SELECT a.id, arg_min(CAST(b.doc_id AS VARCHAR), (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)), CAST(b.doc_id AS VARCHAR))) AS of
 FROM tsh a JOIN sh b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6 GROUP BY 1),
o AS MATERIALIZED (SELECT id, hi, lo, row_number() OVER (ORDER BY id) AS i FROM tsh WHERE id NOT IN (SELECT id FROM hit)),
p AS MATERIALIZED (SELECT b.i AS i, list(a.i ORDER BY a.i) AS near FROM o a JOIN o b ON a.i < b.i AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6 GROUP BY 1),
w AS (SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS by
 UNION ALL SELECT o.i, CASE WHEN x.by IS NULL THEN list_append(w.kept, o.i) ELSE w.kept END, x.by
 FROM w JOIN o ON o.i = w.i + 1 LEFT JOIN p ON p.i = o.i, LATERAL (SELECT list_min(list_intersect(w.kept, p.near)) AS by) x)
SELECT o.id, w.by IS NULL AS kept, CAST(k.id AS VARCHAR) AS near_dup_of FROM w JOIN o ON o.i = w.i LEFT JOIN o k ON k.i = w.by
UNION ALL SELECT id, FALSE, of FROM hit"""


@query("near_dups_against_index", INDEXED_SQL)
def near_dups_against_index(t):
    """Conversation turns against the fingerprints of all documents, then each other."""
    index = dedup.simhash(t.documents, "doc_id", "text", plain=True).select(
        F.col("doc_id").cast("string").alias("entity_id"), "simhash"
    )
    turns = t.conversations.select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), "text")
    return dedup.near_dups(turns, "id", "text", "id", index=index).select("id", "kept", "near_dup_of")


@query(
    "near_index_lookup",
    f"""WITH {SIMHASH_SQL}, turns AS (SELECT item_id AS id, text FROM benchmark), {simhash_sql("turns", "id", "t")},
m AS (SELECT a.id, b.doc_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INTEGER AS distance,
 row_number() OVER (PARTITION BY a.hi, a.lo, a.id ORDER BY b.doc_id) AS r FROM tsh a JOIN sh b
 ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 14)
SELECT id, doc_id, distance, r::INTEGER AS place FROM m WHERE r <= 2""",
)
def near_index_lookup(t):
    """Every benchmark item against a stored index of all documents: the two stored first within 14 bits."""
    index = NearIndex(t.spark, scratch_path(t.spark, "near-index"), max_dist=14, blocks=4)
    docs = dedup.simhash(t.documents, "doc_id", "text", plain=True)
    index.add(docs.select(F.col("doc_id").alias("entity_id"), "simhash", F.col("doc_id").alias("place")), 0)
    items = dedup.fingerprints(t.benchmark, "item_id", "text", "item_id")
    near = index.lookup(items, 1).select(F.col("h").alias("simhash"), F.posexplode("near").alias("n", "e"))
    return items.join(near, "simhash").select(
        F.col("item_id").alias("id"), F.col("e.entity_id").cast("bigint").alias("doc_id"), "e.distance", (F.col("n") + 1).alias("place")
    )


@query("resume_frontier", WALK_SQL)
def resume_frontier(t):
    """A walk stopped after two levels and then gone on with to the end."""
    root = scratch_path(t.spark, "walk")
    graph.resume_frontier(edges(t), first_pages(t), root, 2)
    return graph.resume_frontier(edges(t), first_pages(t), root)


# ------------------------------------------------------- sources and sinks, written and read back

PART_JSON = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("json_table", "SELECT * FROM part")
def json_table(t):
    path = scratch_path(t.spark, "json")
    io.write_table(t.part, path, "json")
    return io.read_json_table(t.spark, path, PART_JSON, lines=True)


@query("jsonl_append", "SELECT * FROM part UNION ALL SELECT * FROM part")
def jsonl_append(t):
    path = scratch_path(t.spark, "jsonl")
    io.write_jsonl(t.part, path)
    io.write_jsonl(t.part, path)
    return t.spark.read.schema(PART_JSON).json(path)


@query(
    "csv_export",
    "SELECT p_partkey, p_name, p_retailprice FROM part",
)
def csv_export(t):
    path = scratch_path(t.spark, "csv")
    columns = ["p_partkey", "p_name", "p_retailprice"]
    io.export_table(t.part, columns, columns, path, "csv")
    return t.spark.read.schema("p_partkey bigint, p_name string, p_retailprice double").option("header", True).csv(path)


APPENDED = {"title": "concat('doc ', CAST(doc_id AS VARCHAR(20)))", "source": "source",
            "timestamp": "CASE WHEN doc_id % 2 = 0 THEN NULL ELSE TIMESTAMP '2024-01-02 03:04:05' END"}


@query(
    "append_record",
    f"""WITH {cte("d", "documents", APPENDED).replace(" AS timestamp", ' AS ts')} SELECT sha256(title || chr(31) || source) AS id, title,
 coalesce(ts, TIMESTAMP '2024-01-31 00:00:00') AS stamp FROM d""",
)
def append_record(t):
    from .base import now

    path = scratch_path(t.spark, "append")
    rows = t.documents.select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source",
        F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")).alias("timestamp"),
    )
    io.append_record(rows, path, ["title", "source"], now())
    return t.spark.read.parquet(path).select("id", "title", F.col("timestamp").alias("stamp"))


@query("page_stream", "SELECT page_id, url, md5(html) AS body FROM pages")
def page_stream(t):
    root = scratch_path(t.spark, "landing")
    t.pages.write.parquet(root)
    out = io.read_pages(t.spark, root, streaming=True).select("page_id", "url", F.md5("html").alias("body"))
    return drain(t, out, "pages")


# ------------------------------------------------------------ other source formats, written and read back


TREE = {"id": "doc_id", "g": "doc_id % 97", "line": "replace(replace(text, chr(10), ' '), chr(13), ' ')"}


@query(
    "project_tree",
    f"""WITH {cte("d", "documents", TREE)}, f AS (SELECT g, string_agg(line, chr(10) ORDER BY id) || chr(10) AS body FROM d GROUP BY 1)
SELECT g, strlen(body)::BIGINT AS length, md5(CASE WHEN strlen(body) > 50000 THEN printf('{io.OVERSIZED}', strlen(body)::VARCHAR) ELSE body END) AS content_md5 FROM f""",
)
def project_tree(t):
    """Documents written as text files of a tree, some in a skipped folder; the tree read back."""
    root = scratch_path(t.spark, "tree")
    lines = derive(t.documents, TREE).repartition(8, "g").sortWithinPartitions("g", "id")
    lines.select("g", "line").write.partitionBy("g").text(f"{root}/notes")
    lines.filter("id % 5 = 0").select("line").write.text(f"{root}/notes/{io.SKIPPED_DIRS[0]}")
    lines.filter("id % 7 = 0").select("line").write.csv(f"{root}/tables")
    out = io.read_project_tree(t.spark, root)
    g = F.regexp_extract("path", r"^notes/g=(\d+)/", 1)
    return out.select(g.cast("bigint").alias("g"), F.col("length").cast("bigint").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("json_arrays", "SELECT * FROM part")
def json_arrays(t):
    """Files that hold one JSON array each, of at most a thousand keys."""
    path = scratch_path(t.spark, "arrays")
    arrays = t.part.groupBy(F.floor(F.col("p_partkey") / 1000).alias("bucket")).agg(
        F.to_json(F.collect_list(F.struct(*t.part.columns))).alias("value")
    )
    arrays.write.partitionBy("bucket").text(path)
    return io.read_json_table(t.spark, f"{path}/*/*.txt", PART_JSON)


def _zipped(rows):
    """A zip archive for each task: members of a hundred entries, one of them broken."""

    def pack(batches):
        import io as memory
        import json
        import zipfile

        import pandas as pd

        for n, pdf in enumerate(batches):
            held = memory.BytesIO()
            entries = [{k: v for k, v in r.items() if v is not None} for r in pdf.drop(columns="path").to_dict("records")]
            with zipfile.ZipFile(held, "w") as z:
                for at in range(0, len(entries), 100):
                    z.writestr(f"m{at:06d}.json", json.dumps(entries[at : at + 100]))
                z.writestr("broken.json", "[{")
                z.writestr("notes.txt", "[]")
            yield pd.DataFrame({"path": [f"{pdf['path'].iloc[0]}-{n}"], "content": [held.getvalue()]})

    return rows.mapInPandas(pack, "path string, content binary")


@query(
    "json_archive",
    """SELECT 'CVE-' || p_partkey AS cve_id, p_name AS description, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_type END AS severity,
 'Unknown' AS affected_os, NULL::VARCHAR AS published FROM part""",
)
def json_archive(t):
    """Entries without severity get the default; a broken member is passed over."""
    rows = t.part.select(
        F.lit("a").alias("path"),
        F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"),
        F.col("p_name").alias("description"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("severity"),
    )
    return io.unpack_archives(_zipped(rows))


@query(
    "scan_xml",
    """SELECT '10.0.' || s_nationkey || '.' || s_suppkey AS ip, 22 AS port, 'tcp' AS protocol, 'open' AS state, s_name AS service, '' AS version, 'p' || s_nationkey AS product FROM supplier
UNION ALL SELECT '10.0.' || s_nationkey || '.' || s_suppkey, s_suppkey, 'udp', 'closed', 'unknown', '', '' FROM supplier""",
)
def scan_xml(t):
    """Hosts written as a scanner's XML and read back as ports."""
    path = scratch_path(t.spark, "xml")
    host = F.concat(F.lit("10.0."), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"))

    def port(number, protocol, state, name, product):
        service = F.struct(name.alias("_name"), F.lit(None).cast("string").alias("_version"), product.alias("_product"))
        return F.struct(
            number.cast("int").alias("_portid"), F.lit(protocol).alias("_protocol"),
            F.struct(F.lit(state).alias("_state")).alias("state"), service.alias("service"),
        )

    none = F.lit(None).cast("string")
    rows = t.supplier.select(
        F.struct(F.lit("up").alias("_state")).alias("status"),
        F.array(F.struct(host.alias("_addr"), F.lit("ipv4").alias("_addrtype"))).alias("address"),
        F.struct(
            F.array(
                port(F.lit(22), "tcp", "open", F.col("s_name"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string"))),
                port(F.col("s_suppkey"), "udp", "closed", none, none),
            ).alias("port")
        ).alias("ports"),
    )
    rows.write.format("xml").option("rowTag", "host").option("rootTag", "scan").save(path)
    return io.scan_ports(io.read_scan_xml(t.spark, path))


@query(
    "make_dictionary",
    "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, TRUE AS same_anywhere, TRUE AS centred, TRUE AS wide FROM embeddings",
)
def make_dictionary(t):
    """A random dictionary with a feature for each vector: its size, its spread, and no trace of partitions."""
    from ..operators import vectors

    made = vectors.make_dictionary(t.spark, t.embeddings.count(), 64, 7)
    key = F.xxhash64("feature_id", "weights")
    again = vectors.make_dictionary(t.spark, t.embeddings.count(), 64, 7).repartition(7).select(key.alias("h"))
    both = made.select(key.alias("h")).join(again, "h").count()
    w = made.select("feature_id", F.explode("weights").alias("w"))
    n = made.count()
    return w.agg(
        F.count_distinct("feature_id").alias("n"),
        F.count_distinct("feature_id").alias("ids"),
        F.lit(both == n).alias("same_anywhere"),
        (F.abs(F.avg("w")) < 0.001).alias("centred"),
        (F.abs(F.stddev("w") / vectors.WEIGHT_SIGMA - 1) < 0.05).alias("wide"),
    )
