"""Named parsers, enrichers and extractors as DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

Transform = Callable[[DataFrame], DataFrame]


@dataclass
class Parser:
    """``parse`` gets the routed pages and returns rows of ``columns``."""

    name: str
    parse: Transform
    columns: tuple[str, ...]
    can_parse: Column
    priority: int = 0
    enabled: bool = True


@dataclass
class Registry:
    parsers: dict[str, Parser] = field(default_factory=dict)
    enrichers: dict[str, tuple[Transform, str]] = field(default_factory=dict)
    extractors: dict[str, Transform] = field(default_factory=dict)
    default: str | None = None

    def register_parser(self, parser: Parser, default: bool = False) -> None:
        self.parsers[parser.name] = parser
        if default:
            self.default = parser.name

    def enable(self, name: str, on: bool = True) -> None:
        self.parsers[name].enabled = on

    def enabled(self) -> list[Parser]:
        live = [p for p in self.parsers.values() if p.enabled]
        if not live:
            raise RuntimeError("no enabled parser")
        return sorted(live, key=lambda p: (-p.priority, p.name))

    def route(self, df: DataFrame, hint: str | None = None) -> DataFrame:
        """Adds ``parser``: the hint when enabled, else the first that can parse."""
        live = self.enabled()
        names = [p.name for p in live]
        chosen = F.when(F.col(hint).isin(names), F.col(hint)) if hint else None
        for p in live:
            test = F.coalesce(p.can_parse, F.lit(False))
            chosen = F.when(test, p.name) if chosen is None else chosen.when(test, p.name)
        fallback = self.default if self.default in names else None
        return df.withColumn("parser", chosen.otherwise(F.lit(fallback).cast("string")))

    def parse_all(self, df: DataFrame, hint: str | None = None) -> DataFrame:
        """Union of every parser over its share; unrouted pages give no rows."""
        routed = self.route(df, hint)
        out = None
        for p in self.enabled():
            rows = p.parse(routed.filter(F.col("parser") == p.name).drop("parser"))
            rows = rows.select(F.lit(p.name).alias("parser"), *p.columns)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def register_enricher(self, name: str, transform: Transform, check: str = "true") -> None:
        """``check`` is an SQL test of the enriched row; a failing row is reported."""
        self.enrichers[name] = (transform, check)

    def enrich(self, df: DataFrame) -> DataFrame:
        """All enrichers in order; failed checks end up in ``enrichment_errors``."""
        errors = []
        for i, (name, (transform, check)) in enumerate(self.enrichers.items()):
            df = transform(df)
            mark = f"__e{i}"
            df = df.withColumn(mark, F.coalesce(F.expr(check), F.lit(False)))
            errors.append(
                F.when(~F.col(mark), F.struct(F.lit(name).alias("enricher"), F.lit(check).alias("failed")))
            )
        listed = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else None
        if listed is None:
            return df
        return df.withColumn("enrichment_errors", listed).drop(*[f"__e{i}" for i in range(len(errors))])

    def register_extractor(self, kind: str, transform: Transform) -> None:
        self.extractors[kind] = transform

    def extract_all(self, df: DataFrame) -> DataFrame:
        """Rows of every registered kind, tagged with it; an extractor of several kinds tags its own."""
        out = None
        for kind, transform in self.extractors.items():
            rows = transform(df)
            rows = rows if "kind" in rows.columns else rows.withColumn("kind", F.lit(kind))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out
