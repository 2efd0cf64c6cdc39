"""Link-graph expansion, robots verdicts, change history, name containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import truthy
from ..functions.urls import authority, url_path
from ..runtime import cut_lineage, scratch_path

NAME_NOISE = r"[^a-z0-9]"


def expand_frontier(
    edges: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """(url, depth) reached from ``seeds(url)`` over ``edges(src, dst)``, level by level.

    ``max_depth=None`` goes on until nothing new is found; 0 gives the seeds.
    With a page cap, whole levels are kept first and the last one in url order.
    Every level is written out, so a lost executor costs one level at most.
    """
    links = edges.select("src", "dst").distinct()
    level = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    visited, taken, depth = level, level.count(), 0
    if max_pages is not None and taken >= max_pages:
        return level.orderBy("url").limit(max_pages)
    while max_depth is None or depth < max_depth:
        depth += 1
        found = (
            links.join(level.select(F.col("url").alias("src")), "src", "left_semi")
            .select(F.col("dst").alias("url"))
            .distinct()
            .join(visited.select("url"), "url", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        level = cut_lineage(found)
        size = level.count()
        if size == 0:
            break
        if max_pages is not None and taken + size >= max_pages:
            return visited.unionByName(level.orderBy("url").limit(max_pages - taken))
        taken += size
        visited = visited.unionByName(level)
    return visited


def resume_frontier(
    edges: DataFrame, seeds: DataFrame, state_dir: str | None = None, max_depth: int | None = None
) -> DataFrame:
    """As :func:`expand_frontier`, but each level is a table in ``state_dir``.

    A run that was stopped goes on from the last complete level: a level counts
    once its writer has left the ``_SUCCESS`` marker.
    """
    spark = edges.sparkSession
    root = state_dir or scratch_path(spark, "frontier")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda d: fs.exists(fs_path(f"{root}/depth={d}/_SUCCESS"))
    read = lambda d: spark.read.parquet(f"{root}/depth={d}").select("url", F.lit(d).alias("depth"))
    depth = 0
    if not done(0):
        seeds.select("url").distinct().write.mode("overwrite").parquet(f"{root}/depth=0")
    links = edges.select("src", "dst").distinct()
    visited = read(0)
    while max_depth is None or depth < max_depth:
        level, depth = read(depth), depth + 1
        if not done(depth):
            (
                links.join(level.select(F.col("url").alias("src")), "src", "left_semi")
                .select(F.col("dst").alias("url"))
                .distinct()
                .join(visited.select("url"), "url", "left_anti")
                .write.mode("overwrite")
                .parquet(f"{root}/depth={depth}")
            )
        fresh = read(depth)
        if fresh.isEmpty():
            break
        visited = visited.unionByName(fresh)
    return visited


def robots_rules(files: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """robots.txt texts to ``robots_verdict``'s rules (domain, ordinal, agent, allow, path, crawl_delay).

    Consecutive agent lines open a group that holds until the next agent line after a
    directive.  Each allow or disallow line with a path gives a row for each agent of its
    group, in file order; an empty disallow allows everything.  A group's delay stands on all
    of its rows, or on one that allows everything if it has no other.  Comments, unknown
    fields, lines before any agent and values that are no number are passed over.
    """
    order = Window.partitionBy("domain").orderBy("i")
    lines = files.select(
        F.col(domain).alias("domain"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("i", "line")
    ).withColumn("line", F.regexp_replace("line", "#.*$", ""))
    pairs = lines.select(
        "domain", "i",
        F.lower(F.trim(F.regexp_extract("line", r"^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(order), F.lit(False))
    grouped = pairs.withColumn("opens", opens.cast("int")).withColumn("grp", F.sum("opens").over(order)).filter("grp > 0")
    agents = grouped.filter(is_agent).groupBy("domain", "grp", F.lower("value").alias("agent")).agg(F.min("i").alias("first"))
    delays = (
        grouped.filter("field = 'crawl-delay'")
        .select("domain", "grp", "i", F.col("value").try_cast("double").alias("d"))
        .filter("d >= 0")
        .groupBy("domain", "grp")
        .agg(F.min_by("d", "i").alias("crawl_delay"))
    )
    ruled = grouped.filter("field IN ('allow', 'disallow')").select(
        "domain", "grp", F.col("i").alias("ordinal"),
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        F.when(F.col("value") == "", "/").otherwise(F.col("value")).alias("path"),
    )
    bare = delays.join(ruled, ["domain", "grp"], "left_anti").select(
        "domain", "grp", F.lit(1 << 30).alias("ordinal"), F.lit(True).alias("allow"), F.lit("/").alias("path")
    )
    return (
        ruled.unionByName(bare)
        .join(agents, ["domain", "grp"])
        .join(delays, ["domain", "grp"], "left")
        .select("domain", "ordinal", "agent", "allow", "path", "crawl_delay")
    )


def robots_verdict(urls: DataFrame, rules: DataFrame, agent: str, default_delay: int = 1) -> DataFrame:
    """First matching robots rule per url.

    ``rules(domain, ordinal, agent, allow, path, crawl_delay)``.  A prefix test is
    turned into equality: a url offers its path cut to each rule length of its
    host, and meets one row per (host, path).  Thus a host with very many urls
    or rules never pairs all of one with all of the other.
    """
    mine = rules.filter(
        (F.col("agent") == "*") | F.lit(agent.lower()).contains(F.lower("agent"))
    )
    hosts = mine.groupBy("domain").agg(
        F.collect_set(F.length("path")).alias("lengths"),
        F.min_by(
            "crawl_delay",
            F.when(F.col("crawl_delay").isNotNull(), F.struct("ordinal", (-F.col("crawl_delay")).alias("d"))),
        ).alias("host_delay"),
    )
    firsts = mine.groupBy("domain", "path").agg(
        F.min(F.struct("ordinal", "allow")).alias("rule")
    )
    base = urls.withColumn("domain", authority("url"))
    known = base.select("domain", "url").distinct().join(hosts, "domain")
    path = url_path("url")
    cuts = known.select(
        "domain", "url",
        F.explode(F.filter("lengths", lambda n: n <= F.length(path))).alias("n"),
    ).select("domain", "url", F.substring(path, F.lit(1), F.col("n")).alias("path"))
    best = (
        cuts.join(firsts, ["domain", "path"])
        .groupBy("url")
        .agg(F.min("rule").alias("rule"))
    )
    delays = hosts.select("domain", "host_delay")
    return (
        base.join(best, "url", "left")
        .join(delays, "domain", "left")
        .select(
            *urls.columns,
            F.col("domain") if "domain" not in urls.columns else F.col("domain").alias("__host"),
            F.coalesce("rule.allow", F.lit(True)).alias("allowed"),
            F.when(F.coalesce("rule.allow", F.lit(True)), "allowed")
            .otherwise("disallowed_by_robots")
            .alias("reason"),
            F.coalesce("host_delay", F.lit(default_delay)).alias("crawl_delay"),
        )
        .drop("__host")
    )


def history_change(df: DataFrame, history: DataFrame) -> DataFrame:
    """Fetches against stored history: new, not_modified, unchanged or changed.

    Both sides carry ``url, content_hash``; the fetch also a ``status``.
    """
    old = history.select(
        "url", F.col("content_hash").alias("previous_hash"), F.lit(True).alias("__known")
    )
    change = (
        F.when(F.col("status").startswith("304"), "not_modified")
        .when(F.col("__known").isNull(), "new")
        .when(F.col("content_hash") == F.col("previous_hash"), "unchanged")
        .otherwise("changed")
    )
    return df.join(old, "url", "left").withColumn("change_type", change).drop("__known")


def content_changes(
    df: DataFrame, key: str, ts: str, tie: str, content: Column, chunk: str = "day"
) -> DataFrame:
    """Adds ``previous_hash`` and ``change_type`` along each key's history.

    Time chunks keep a hot key off a single task: only the last value of each
    chunk is carried into the next.
    """
    base = df.withColumn("__h", content).withColumn("__chunk", F.date_trunc(chunk, F.col(ts)))
    inside = Window.partitionBy(key, "__chunk").orderBy(ts, tie)
    last = base.groupBy(key, "__chunk").agg(F.max_by("__h", F.struct(ts, tie)).alias("__last"))
    carried = last.select(
        key, "__chunk",
        F.lag("__last").over(Window.partitionBy(key).orderBy("__chunk")).alias("__carry"),
    )
    before = F.coalesce("__prev", "__carry")
    change = (
        F.when(before.isNull(), "new").when(before == F.col("__h"), "unchanged").otherwise("changed")
    )
    return (
        base.withColumn("__prev", F.lag("__h").over(inside))
        .join(carried, [key, "__chunk"])
        .select(*df.columns, before.alias("previous_hash"), change.alias("change_type"))
    )


def core_name(c: Column | str) -> Column:
    """Letters and digits of a lower-cased name."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), NAME_NOISE, "")


def containment_join(
    df: DataFrame, name: str, names: DataFrame, wanted: str, ordinal: str
) -> DataFrame:
    """First wanted name (by ``ordinal``) contained in each row's name; others drop.

    The substring test becomes equality: each distinct name offers its pieces of
    just the lengths that are wanted, and pieces meet wanted names by hash.
    """
    cores = (
        names.select(core_name(wanted).alias("piece"), F.col(wanted).alias("matched"), F.col(ordinal).alias("__ord"))
        .filter(truthy("piece"))
        .groupBy("piece")
        .agg(F.min(F.struct("__ord", "matched")).alias("hit"))
    )
    lengths = cores.agg(F.collect_set(F.length("piece"))).scalar()
    probe = df.select(core_name(name).alias("core")).filter(truthy("core")).distinct()
    sized = probe.select("core", F.explode(lengths).alias("n")).filter(F.col("n") <= F.length("core"))
    pieces = sized.select(
        "core", F.explode(F.sequence(F.lit(1), F.length("core") - F.col("n") + 1)).alias("s"), "n"
    ).select("core", F.substring(F.col("core"), F.col("s"), F.col("n")).alias("piece"))
    hits = pieces.join(cores, "piece").groupBy("core").agg(F.min("hit").alias("hit"))
    return (
        df.withColumn("__core", core_name(name))
        .join(hits, F.col("__core") == F.col("core"))
        .select(*df.columns, F.col("hit.matched").alias("matched"))
    )


def attach_page_id(df: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """Enrichment rows with the id of their page: the least one if several pages share a url."""
    return df.join(pages.groupBy(key).agg(F.min("page_id").alias("page_id")), key)


# Columns of each typed page-enrichment output.
ENRICHMENT_COLUMNS = {
    "videos": ("video_url", "title", "description_snippet", "uploader", "platform", "video_id", "embed_code"),
    "geo_location": ("latitude", "longitude", "location_description", "source_of_geo_info", "notes"),
    "related_links": ("link_type", "url", "title", "description"),
    "related_socials": ("platform", "author_handle", "comment_summary", "entity_id", "url", "timestamp", "comment"),
}


def typed_enrichment(df: DataFrame, pages: DataFrame, kind: str, page_key: str = "page_url") -> DataFrame:
    """One kind of accepted enrichment rows in its output shape."""
    columns = [
        F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
        for c in ENRICHMENT_COLUMNS[kind]
    ]
    ids = pages.groupBy(F.col("url").alias(page_key)).agg(F.min("page_id").alias("page_id"))
    rows = df.filter(F.col("kind") == kind).select(page_key, *columns)
    return rows.join(ids, page_key).select("page_id", *ENRICHMENT_COLUMNS[kind])
