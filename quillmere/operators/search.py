"""Table and log search, paging, knowledge reads, newest-first views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fields import coalesce_fields


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_ci(c: Column | str, text: str) -> Column:
    """Case-insensitive substring with the text taken literally."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c.cast("string")).contains(text.lower()), F.lit(False))


@dataclass(frozen=True)
class SearchSpec:
    """What to look for in one table; only ``columns`` may be used or returned."""

    columns: Sequence[str]
    equals: Mapping[str, Any] = field(default_factory=dict)
    at_least: Mapping[str, Any] = field(default_factory=dict)
    at_most: Mapping[str, Any] = field(default_factory=dict)
    text: str = ""
    text_columns: Sequence[str] = ()
    sort: str | None = None
    descending: bool = False
    tie: str | None = None
    page: int = 1
    page_size: int = 50


def _matching(df: DataFrame, spec: SearchSpec) -> DataFrame:
    allowed = set(spec.columns)
    tests = [F.col(c) == F.lit(v) for c, v in spec.equals.items() if c in allowed and v not in (None, "")]
    tests += [F.col(c) >= F.lit(v) for c, v in spec.at_least.items() if c in allowed and v is not None]
    tests += [F.col(c) <= F.lit(v) for c, v in spec.at_most.items() if c in allowed and v is not None]
    text = spec.text.strip()
    searched = [c for c in spec.text_columns if c in allowed]
    if text and searched:
        tests.append(_any([contains_ci(c, text) for c in searched]))
    for test in tests:
        df = df.filter(test)
    return df


def paged(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page of a total order; Spark keeps only its top rows per task."""
    out = df.orderBy(*order)
    skip = (page - 1) * page_size
    return (out.offset(skip) if skip else out).limit(page_size)


def search(df: DataFrame, spec: SearchSpec) -> tuple[DataFrame, DataFrame]:
    """(page of rows, one-row total).  An unknown sort column means the first."""
    hits = _matching(df, spec)
    by = spec.sort if spec.sort in spec.columns else spec.columns[0]
    first = F.col(by).desc() if spec.descending else F.col(by).asc()
    tie = [F.col(spec.tie or spec.columns[0]).asc()]
    rows = paged(hits.select(*spec.columns), [first, *tie], spec.page, spec.page_size)
    return rows, hits.agg(F.count("*").alias("total"))


@dataclass(frozen=True)
class LogSpec:
    severity: Sequence[str] = ()
    equals: Mapping[str, Any] = field(default_factory=dict)
    start: str | None = None
    end: str | None = None
    text: str = ""
    page: int = 1
    page_size: int = 50


def search_log(df: DataFrame, spec: LogSpec, tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Activity log, newest first; text looks into message, type and payload."""
    if spec.severity:
        df = df.filter(F.col("severity").isin(list(spec.severity)))
    for name, value in spec.equals.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == F.lit(value))
    if spec.start:
        df = df.filter(F.col("timestamp") >= F.lit(spec.start).cast("timestamp_ntz"))
    if spec.end:
        df = df.filter(F.col("timestamp") <= F.lit(spec.end).cast("timestamp_ntz"))
    text = spec.text.strip()
    if text:
        df = df.filter(_any([contains_ci(c, text) for c in ("message", "event_type", "data")]))
    order = [F.col("timestamp").desc()] + ([F.col(tie).desc()] if tie else [])
    return paged(df, order, spec.page, spec.page_size), df.agg(F.count("*").alias("total"))


def flatten_payload(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Payload keys as columns; a key the table already has is left alone."""
    fresh = [k for k in keys if k not in df.columns]
    if not fresh:
        return df
    schema = T.StructType([T.StructField(k, T.StringType()) for k in fresh])
    parsed = F.from_json(F.col(column), schema)
    return df.withColumn("__p", parsed).select(*df.columns, *[F.col("__p")[k].alias(k) for k in fresh])


def payload_map(df: DataFrame, column: str, name: str = "payload") -> DataFrame:
    """All payload keys that are not columns, as a string map (open key set)."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.withColumn(name, F.map_filter(parsed, lambda k, _: ~k.isin(list(df.columns))))


def read_knowledge(df: DataFrame, kind: str | None = None) -> DataFrame:
    """Knowledge rows, newest first; the source stands in for a missing url."""
    if kind:
        df = df.filter(F.col("type") == kind)
    url = F.coalesce(coalesce_fields("url", "source"), F.lit(""))
    return df.withColumn("url", url).orderBy(F.col("timestamp").desc())


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """Rows the test does not hold for; null tests keep the row."""
    return df.filter(~F.coalesce(test, F.lit(False)))


def latest_n(df: DataFrame, ts: str, n: int, tie: str | None = None) -> DataFrame:
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    return df.orderBy(*order).limit(n)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    """Newest row per key by a mergeable aggregate, so hot keys shrink map-side."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(ts, tie) if tie else F.col(ts)
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(key, "r.*")


def within_last(df: DataFrame, ts: str, now: Column, hours: int) -> DataFrame:
    return df.filter(F.col(ts) > now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def updated_since(df: DataFrame, ts: str, since: Column, test: Column | None = None) -> DataFrame:
    """Rows changed after a moment, plus an optional further test."""
    out = df.filter(F.col(ts).isNotNull() & (F.col(ts) > since))
    return out if test is None else out.filter(test)
