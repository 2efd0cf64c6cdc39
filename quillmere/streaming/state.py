"""Keyed crawl state, activity feed and TTL de-duplication on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fields import status_code
from ..operators.crawl_queue import error_streaks
from .groups import OrderedRows
from .sinks import VersionedTable

FEED_SIZE = 500
POLICY_STATUSES = ("disallowed_by_policy", "delayed_by_policy")
_STATE = "url string, seq bigint, ts timestamp_ntz, etag string, content_hash string, http_status int, consecutive_errors bigint, change_type string"


def _fetches(df: DataFrame) -> DataFrame:
    """Fetch log in one shape; policy refusals leave the history alone."""
    return df.filter(~F.col("status").isin(*POLICY_STATUSES)).select(
        F.col("url").cast("string").alias("url"),
        F.col("seq").cast("bigint").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("status"),
        F.col("etag").cast("string").alias("etag"),
        F.col("content_hash").cast("string").alias("content_hash"),
        status_code("status").alias("http_status"),
    )


class _CrawlState(StatefulProcessor):
    """etag, hash, last status and consecutive errors of one url."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "etag string, hash string, errors long, status int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        etag, known, errors, status = self.state.get() or (None, None, 0, 0)
        out = []
        for r in pdf.itertuples(index=False):
            if r.status.startswith("200"):
                change = "new" if known is None else "unchanged" if known == r.content_hash else "changed"
                etag, known, errors = r.etag, r.content_hash, 0
            elif r.status.startswith("304"):
                change, errors = "not_modified", 0
            else:
                change, errors = "error", errors + 1
            if change != "not_modified":  # an unmodified page keeps the status it had
                status = int(r.http_status)
            out.append((r.url, r.seq, r.ts, etag, known, status, errors, change))
        self.state.update((etag, known, errors, status))
        yield pd.DataFrame(
            out, columns=["url", "seq", "ts", "etag", "content_hash", "http_status", "consecutive_errors", "change_type"]
        )

    def close(self) -> None:
        pass


def crawl_state(stream: DataFrame) -> DataFrame:
    """Per fetch (``url, seq, ts, status, etag, content_hash``) the url's state after it."""
    return (
        _fetches(stream)
        .groupBy("url")
        .transformWithStateInPandas(
            statefulProcessor=_CrawlState(), outputStructType=_STATE, outputMode="append", timeMode="none"
        )
    )


def crawl_state_batch(df: DataFrame) -> DataFrame:
    """The final state per url of a table of fetches; hot urls are cut by time."""
    rows = _fetches(df)
    ok = F.col("status").startswith("200") | F.col("status").startswith("304")
    streaks = error_streaks(rows, "url", "ts", "seq", ok)
    when = F.struct("ts", "seq")
    got = F.when(F.col("status").startswith("200"), when)
    return streaks.groupBy("url").agg(
        F.max_by("etag", got).alias("etag"),
        F.max_by("content_hash", got).alias("content_hash"),
        F.coalesce(
            F.max_by("http_status", F.when(~F.col("status").startswith("304"), when)), F.lit(0)
        ).alias("http_status"),
        F.max_by("streak", when).alias("consecutive_errors"),
        F.max("ts").alias("last_crawled_at"),
    )


def newest(df: DataFrame, cap: int = FEED_SIZE, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The newest ``cap`` rows; each task keeps its own best before they meet."""
    return df.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(cap)


def feed_sink(table: VersionedTable, cap: int = FEED_SIZE, ts: str = "ts", seq: str = "seq"):
    """``foreachBatch`` function that keeps a bounded feed of the newest entries.

    The cap is the feature; entries that leave the feed stay in the log itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        held = table.read(before=batch_id)
        fresh = newest(batch.select(*held.columns), cap, ts, seq)
        table.write(newest(held.unionByName(fresh), cap, ts, seq), batch_id)

    return write


def live_counts(df: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Entries per window, type and severity; works on tables and streams alike."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, window).alias("w"), "event_type", "severity").agg(
        F.count("*").alias("n")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "severity", "n")


def dedup_within(stream: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """First row per key within the time to live; older keys are forgotten."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def dedup_within_batch(df: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    """First row per key of a table."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts, seq)).alias("r"))
    return first.select(*keys, "r.*").select(*df.columns)


def _when(row: tuple) -> tuple:
    """Order of (ts, seq, ...), nulls last."""
    return tuple(x for v in row[:2] for x in (v is None, 0 if v is None else v))


class _TtlCache(StatefulProcessor):
    """Last fetched value per key, forgotten after a time to live."""

    def __init__(self, ttl_ms: int, forget: bool) -> None:
        self.ttl_ms, self.forget = ttl_ms, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl_ms if self.forget else None
        self.value = handle.getValueState("value", "value string, at timestamp", ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Rows, not frames: keys are many and have few rows each, and a frame costs more than they do.
        held, out = self.value.get(), []
        for ts, seq, value in sorted(((r["ts"], r["seq"], r["value"]) for r in rows), key=_when):
            hit = held is not None and None not in (ts, held[1]) and (ts - held[1]).total_seconds() * 1000 <= self.ttl_ms
            if not hit:
                held = (value, ts)
            out.append(Row(key=key[0], seq=seq, value=held[0], hit=hit))
        self.value.update(held)
        yield from out

    def close(self) -> None:
        pass


def ttl_cache(stream: DataFrame, key: str, value: str, ts: str, seq: str, ttl_seconds: int, forget: bool = False) -> DataFrame:
    """Serve the cached value of a key until it is older than the time to live.

    Age is told by the rows' own times.  ``forget`` also drops idle keys from the
    state by the clock, which suits a query that never ends.
    """
    rows = stream.select(
        F.col(key).cast("string").alias("key"),
        F.col(seq).cast("bigint").alias("seq"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(value).cast("string").alias("value"),
    )
    return rows.groupBy("key").transformWithState(
        statefulProcessor=_TtlCache(ttl_seconds * 1000, forget),
        outputStructType="key string, seq bigint, value string, hit boolean",
        outputMode="append",
        timeMode="ProcessingTime" if forget else "none",
    )


class _LruCache(StatefulProcessor):
    """At most ``size`` values by key, least recently used out first, each valid for a time to live."""

    def __init__(self, size: int, ttl_ms: int) -> None:
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # ``used`` orders the entries by their last use.
        self.entries = handle.getMapState("entries", "key string", "value string, at timestamp, used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordered = OrderedRows(rows, (), ("key", "value"))
        stored = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        # Never more than ``size`` entries; a dict keeps the order of use.
        held = {k: (v[0], pd.Timestamp(v[1])) for k, v in sorted(stored.items(), key=lambda x: x[1][2])}
        used = max((v[2] for v in stored.values()), default=0)
        life = pd.Timedelta(milliseconds=self.ttl_ms)
        for _, piece in ordered.pieces():
            out = []
            for name, seq, ts, value in zip(piece["key"], piece["seq"], piece["ts"], piece["value"], strict=True):
                entry = held.pop(name, None)
                hit = entry is not None and ts - entry[1] < life
                held[name] = entry if hit else (value, ts)
                if len(held) > self.size:
                    del held[next(iter(held))]
                out.append((key[0], name, seq, held[name][0], hit))
            yield pd.DataFrame(out, columns=["cache", "key", "seq", "value", "hit"])
        for name in stored.keys() - held.keys():
            self.entries.removeKey((name,))
        for place, (name, (value, at)) in enumerate(held.items(), used + 1):
            self.entries.updateValue((name,), (value, at.to_pydatetime(), place))

    def close(self) -> None:
        pass


def lru_cache(
    stream: DataFrame, cache: str, key: str, value: str, ts: str, seq: str, size: int = 128, ttl_seconds: int = 300
) -> DataFrame:
    """(cache, key, seq, value, hit): each request served from its cache, or with its own value, which is then kept.

    A value is valid for ``ttl_seconds`` after it was fetched; using it does not renew it, but makes it the
    most recent.  A full cache gives up the entry that was used least recently, expired or not.  Ages are
    told by the rows' own times, in their order.  State is one map of at most ``size`` entries a cache.
    """
    rows = stream.select(
        F.col(cache).cast("string").alias("cache"),
        F.col(key).cast("string").alias("key"),
        F.col(seq).cast("bigint").alias("seq"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(value).cast("string").alias("value"),
    )
    return rows.groupBy("cache").transformWithStateInPandas(
        statefulProcessor=_LruCache(size, ttl_seconds * 1000),
        outputStructType="cache string, key string, seq bigint, value string, hit boolean",
        outputMode="append",
        timeMode="none",
    )
