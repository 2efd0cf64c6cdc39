"""Registered queries: each reads the supplied tables and may carry its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.io import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW_TEXT = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


class Tables:
    """``t.orders`` reads orders from the folder at hand."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.base, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under a name, with its SQL if it has one."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, base: fn(Tables(spark, base))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cte(name: str, table: str, columns: dict[str, str], where: str = "") -> str:
    """SQL text of a derived input; the same expressions feed ``selectExpr``."""
    body = ",\n    ".join(f"{e} AS {c}" for c, e in columns.items())
    tail = f" WHERE {where}" if where else ""
    return f"{name} AS (\n  SELECT {body}\n  FROM {table}{tail})"


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Input columns made by expressions that both engines read alike."""
    return df.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
