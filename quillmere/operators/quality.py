"""Completeness: missing fields, rank counts, per-field share, table health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.fields import count_true, present, quality_rank, truthy
from .normalize import quality_score

__all__ = [
    "quality_score", "missing_fields", "completion_pct", "rank_counts",
    "field_completeness", "table_health", "table_schema", "table_sample",
]

# Fields that drive a crawl job's completion percentage.
COMPLETION_FIELDS = (
    "tool_name", "description", "category", "official_site_url", "supported_os",
    "tags", "license", "version", "dependencies",
)


def _filled(df: DataFrame, field: str) -> Column:
    """Stricter than truthiness: an empty JSON object is missing, a zero is not."""
    if field not in df.columns:
        return F.lit(False)
    dtype = df.schema[field].dataType
    if isinstance(dtype, T.ArrayType):
        return truthy(field, dtype)
    if isinstance(dtype, T.StringType):
        return F.coalesce(~F.col(field).isin("", "{}"), F.lit(False))
    return F.col(field).isNotNull()


def missing_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    names = F.array(*[F.when(~_filled(df, f), F.lit(f)) for f in fields])
    missing = F.filter(names, lambda x: x.isNotNull())
    score = F.round(F.lit(100.0) * (len(fields) - F.size(missing)) / len(fields), 1)
    return (
        df.withColumn("missing", missing)
        .withColumn("score", score)
        .withColumn("rank", quality_rank("score"))
    )


def completion_pct(df: DataFrame, fields: Sequence[str] = COMPLETION_FIELDS) -> Column:
    """Whole percent of present fields, rounded down."""
    return F.floor(F.lit(100) * count_true([present(df, f) for f in fields]) / len(fields)).cast("int")


def rank_counts(df: DataFrame, rank: str = "quality_rank") -> DataFrame:
    """Rows per rank with the table total on every row."""
    grouped = df.groupBy(rank).agg(F.count("*").alias("n"))
    total = grouped.agg(F.sum("n")).scalar()
    return grouped.withColumn("total", total)


def field_completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Percent of non-null, non-empty values per field, from one scan."""
    def filled(f: str) -> Column:
        if isinstance(df.schema[f].dataType, T.StringType):
            return F.count_if(F.col(f).isNotNull() & (F.col(f) != ""))
        return F.count_if(F.col(f).isNotNull())

    one = df.agg(
        F.count("*").alias("__rows"), *[filled(f).alias(f"__f{i}") for i, f in enumerate(fields)]
    )
    pct = lambda i: F.when(
        F.col("__rows") > 0, F.round(F.lit(100.0) * F.col(f"__f{i}") / F.col("__rows"), 1)
    ).otherwise(F.lit(0.0))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), pct(i).alias("pct")) for i, f in enumerate(fields)]
    )
    return one.select(F.inline(pairs))


def table_health(tables: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Column and row counts per table with a traffic light."""
    parts = []
    for name, df in tables.items():
        want, have = expected[name], len(df.columns)
        status = "healthy" if have == want else "warning" if have >= want - 1 else "danger"
        parts.append(
            df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("name"),
                F.lit(status).alias("status"),
                F.lit(have).alias("columns"),
                "rows",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def table_schema(df: DataFrame, name: str) -> DataFrame:
    """Column listing; its size is the column count."""
    rows = [(name, i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, column_type string"
    )


def table_sample(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
