"""Crawl queue order, transitions, statistics, error streaks, parser choice."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.fields import status_code
from ..functions.urls import authority
from ..runtime import global_row_number

__all__ = ["status_code"]

ENDED = ("completed", "error")
DEFAULT_RESCHEDULE_DAYS = 90
MAX_CONSECUTIVE_ERRORS = 10


def queue_order(df: DataFrame) -> DataFrame:
    """Open or forced jobs: focus, then priority, then oldest."""
    todo = (F.col("status") != "completed") | F.coalesce("force_recrawl_flag", F.lit(False))
    return df.filter(todo).orderBy(
        F.col("focus_score").desc(), F.col("priority").desc(), F.col("id").asc()
    )


def queue_page(df: DataFrame, n: int = 100) -> DataFrame:
    """Head of the queue with the table's size on every row."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.orderBy(F.col("priority").desc(), F.col("id").asc()).limit(n).withColumn("total", total)
    )


def latest_job(df: DataFrame) -> DataFrame:
    """Newest running or completed job, else the newest of all."""
    preferred = F.col("status").isin("running", "completed").cast("int")
    row = F.max_by(F.struct(*df.columns), F.struct(preferred, F.col("id")))
    return df.agg(row.alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def queue_transition(
    df: DataFrame, status: Column, pct: Column, now: Column, days: int = DEFAULT_RESCHEDULE_DAYS
) -> DataFrame:
    """Apply a status; only ended jobs are scheduled again."""
    following = F.when(status.isin(*ENDED), now + F.make_dt_interval(F.lit(days)))
    return df.withColumns(
        {
            "status": status,
            "completion_percentage": pct,
            "last_crawled_at": now,
            "force_recrawl_flag": F.lit(False),
            "next_scheduled_crawl_at": following,
        }
    )


def force_recrawl(df: DataFrame, ids: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Flag the given jobs and set them pending; also the ids that do not exist."""
    mark = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull()
    out = df.join(mark, key, "left").withColumns(
        {
            "status": F.when(hit, "pending").otherwise(F.col("status")),
            "force_recrawl_flag": hit | F.coalesce("force_recrawl_flag", F.lit(False)),
        }
    )
    return out.select(*df.columns), ids.select(key).join(df.select(key), key, "left_anti")


def crawler_stats(df: DataFrame) -> DataFrame:
    """Queue size, totals, errors, derived state and last failure from one scan."""
    status = F.col("status")
    agg = df.agg(
        F.count_if(status.isin("pending", "running")).alias("queue_size"),
        F.count_if(status == "running").alias("running"),
        F.count("*").alias("total_jobs"),
        F.count_if(status == "failed").alias("total_errors"),
        F.max(F.when(status == "failed", F.col("id"))).alias("last_failed_id"),
    )
    state = (
        F.when(F.col("running") > 0, "RUNNING")
        .when(F.col("queue_size") == 0, "IDLE")
        .otherwise("PENDING")
    )
    return agg.withColumn("system_state", state)


def filter_queue(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Equality on status, parser and priority; domain is case-sensitive, text not."""
    for name, column in (("status", "status"), ("parser", "parser_hint"), ("priority", "priority")):
        if spec.get(name) not in (None, ""):
            df = df.filter(F.col(column) == F.lit(spec[name]))
    if spec.get("domain"):
        df = df.filter(F.col("target_url").contains(spec["domain"]))
    if spec.get("text"):
        low = spec["text"].lower()
        df = df.filter(
            F.lower("tool_name").contains(low) | F.lower("target_url").contains(low)
        )
    return df


def recency_counts(df: DataFrame, ts: str, now: Column) -> DataFrame:
    """Rows of the last 24 hours (strict) and those less than seven whole days old."""
    day = F.make_dt_interval(F.lit(1))
    week = F.make_dt_interval(F.lit(7))
    return df.agg(
        F.count_if(F.col(ts) > now - day).alias("last_24h"),
        F.count_if(F.col(ts) > now - week).alias("last_7_days"),
        F.count("*").alias("total"),
    )


def error_streaks(
    df: DataFrame, key: str, ts: str, tie: str, ok: Column, chunk: str = "day"
) -> DataFrame:
    """Adds ``streak``: errors in a row up to and including this one, 0 on success.

    A key's rows are cut into time chunks, so a key with a large share of the
    rows is spread over many tasks.  Each chunk counts its own streaks; a small
    per-chunk summary then tells how long a streak was when the chunk began.
    """
    base = df.withColumn("__ok", F.coalesce(ok, F.lit(False)).cast("int")).withColumn(
        "__chunk", F.date_trunc(chunk, F.col(ts))
    )
    order = Window.partitionBy(key, "__chunk").orderBy(ts, tie)
    local = base.withColumn("__island", F.sum("__ok").over(order))
    inside = Window.partitionBy(key, "__chunk", "__island").orderBy(ts, tie)
    local = local.withColumn("__run", F.sum(1 - F.col("__ok")).over(inside))
    # Same partitioning as the windows above, so this needs no further shuffle.
    at_end = F.when(F.col("__ok") == 1, 0).otherwise(F.col("__run"))
    chunks = local.groupBy(key, "__chunk").agg(
        F.max("__ok").alias("reset"), F.max_by(at_end, F.struct(ts, tie)).alias("tail")
    )
    by_time = Window.partitionBy(key).orderBy("__chunk")
    summary = chunks.withColumn("__resets", F.sum("reset").over(by_time))
    running = Window.partitionBy(key, "__resets").orderBy("__chunk")
    summary = summary.withColumn("__state", F.sum("tail").over(running))
    carried = summary.select(
        key, "__chunk", F.coalesce(F.lag("__state").over(by_time), F.lit(0)).alias("__carry")
    )
    streak = F.when(F.col("__ok") == 1, F.lit(0)).otherwise(
        F.col("__run") + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(F.lit(0))
    )
    return local.join(carried, [key, "__chunk"]).select(
        *df.columns, streak.cast("bigint").alias("streak")
    )


def until_error_limit(
    streaks: DataFrame, key: str, ts: str, tie: str, n: int = MAX_CONSECUTIVE_ERRORS
) -> DataFrame:
    """Rows of each run up to and including its first breach of the limit."""
    breach = (
        streaks.filter(F.col("streak") >= n)
        .groupBy(key)
        .agg(F.min(F.struct(ts, tie)).alias("__stop"))
    )
    return (
        streaks.join(breach, key, "left")
        .filter(F.col("__stop").isNull() | (F.struct(ts, tie) <= F.col("__stop")))
        .drop("__stop")
    )


def latest_training(df: DataFrame, ts: str, tie: str) -> DataFrame:
    """Newest session's time and accuracy; '' and 0 when there is none."""
    row = F.max_by(F.struct(F.col(ts).cast("string").alias("t"), "accuracy"), F.struct(ts, tie))
    return df.agg(row.alias("r")).select(
        F.coalesce("r.t", F.lit("")).alias("last_time"),
        F.coalesce("r.accuracy", F.lit(0.0)).alias("accuracy"),
    )


def choose_parser(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """The hinted parser when enabled, else the one with the highest priority."""
    enabled = registry.filter("enabled")
    best = enabled.agg(F.min_by("name", F.struct(-F.col("priority"), F.col("name")))).scalar()
    hinted = enabled.select(F.col("name").alias("__p")).distinct()
    return (
        jobs.join(hinted, F.col("parser_hint") == F.col("__p"), "left")
        .withColumn("parser", F.coalesce("__p", best))
        .drop("__p")
    )


def reorder(df: DataFrame, position: str, id_col: str, chosen, delta: int) -> DataFrame:
    """Swap the chosen row with its neighbour at ``delta``."""
    if delta == 0:
        raise ValueError("delta must not be 0")
    at = df.filter(F.col(id_col) == F.lit(chosen)).select(position).first()
    if at is None:
        raise KeyError(chosen)
    here = at[0]
    if df.filter(F.col(position) == here + delta).isEmpty():
        raise IndexError("out of bounds")
    moved = (
        F.when(F.col(position) == here, here + delta)
        .when(F.col(position) == here + delta, here)
        .otherwise(F.col(position))
    )
    return df.withColumn(position, moved.cast(df.schema[position].dataType))


def with_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """List positions from 0 for tables that have none yet."""
    return global_row_number(df, order, name, 0)


def discovered_jobs(
    links: DataFrame, queue: DataFrame, score: Column, now: Column, days: int
) -> DataFrame:
    """New queue rows for discovered urls that are not queued yet."""
    fresh = links.groupBy("target_url").agg(
        F.min("tool_name").alias("tool_name"), F.max(score).alias("focus_score")
    )
    return fresh.join(queue.select("target_url").distinct(), "target_url", "left_anti").select(
        "tool_name",
        "target_url",
        F.lit("pending").alias("status"),
        "focus_score",
        (now + F.make_dt_interval(F.lit(days))).alias("next_scheduled_crawl_at"),
        authority("target_url").alias("domain"),
    )
