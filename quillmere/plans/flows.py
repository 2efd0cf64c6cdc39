"""End-to-end flows put together from the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, functions as F

from ..operators import crawl_queue, filters, graph, merge, models, normalize, pages, risk, vectors
from ..runtime import cut_lineage


@dataclass
class Curated:
    accepted: DataFrame
    quarantine: DataFrame
    audit: DataFrame
    tools: DataFrame
    counts: DataFrame


def curate(
    raw: DataFrame,
    stored: DataFrame,
    rules: Sequence[filters.Rule],
    now: Column,
    *,
    order: str,
    keywords: Sequence[str] = (),
    mode: str = "rules_only",
    tables: Mapping[str, DataFrame] | None = None,
) -> Curated:
    """Raw records: normalize, judge, and merge what was accepted into ``stored``.

    ``order`` names a unique integer arrival column of ``raw``; of several rows
    with one id the first to arrive is judged.
    """
    parent = normalize.normalize_parent(raw, now, carry=[order]).filter(F.col("tool_id").isNotNull())
    rest = [c for c in parent.columns if c != "tool_id"]
    first = parent.groupBy("tool_id").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
    ready = cut_lineage(first.select("tool_id", "r.*"))
    accepted, quarantine, audit = filters.filter_records(
        ready, rules, stored, id_col="tool_id", text_col="description",
        key_cols=["tool_id", "tool_name"], tables=tables, keywords=keywords, mode=mode, order=order,
    )
    rows = accepted.select(*[c for c in stored.columns if c in accepted.columns])
    tools, counts = merge.upsert(stored, rows, "tool_id", "overwrite")
    return Curated(accepted, quarantine, audit, tools, counts)


def scan_report(ports: DataFrame) -> dict[str, DataFrame]:
    """All the risk tables of one set of scanned ports."""
    scored = risk.risk_lookups(ports)
    return {
        "ports": scored,
        "summary": risk.scan_summary(ports),
        "by_service": risk.mean_by(ports, "service", "risk_score", "mean_risk"),
        "histogram": risk.histogram(ports, "risk_score"),
        "services": risk.count_by(ports, "service"),
        "boxes": risk.box_stats(ports, "service", "risk_score"),
        "hosts": risk.host_rollup(ports),
        "versions": risk.version_counts(ports),
        "open_ports": risk.incidence(ports.filter("state = 'open'"), "ip", "port"),
        "anomalies": risk.anomaly_split(ports),
        "top": risk.top_n(ports, "risk_score", ["ip", "port"]),
    }


def vector_verdicts(
    embeddings: DataFrame, dictionary: DataFrame, n_features: int, model: Transformer, k: int = 64, dim: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Vectors to top-k, eight sums, probability and verdict; also the rejected ones."""
    good, rejected = vectors.validate_vectors(embeddings, dim)
    sums = vectors.gestalt(vectors.project_topk(good, dictionary, k), n_features)
    return models.score_and_gate(models.with_probability(sums, model)), rejected


def discover(
    page_table: DataFrame, queue: DataFrame, score: Column, now: Column, depth: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pages to their link graph's reachable urls and the new queue rows."""
    edges = cut_lineage(pages.link_edges(page_table))
    reached = graph.expand_frontier(edges, page_table.select("url"), depth)
    links = edges.select(F.col("dst").alias("target_url"), F.col("src").alias("tool_name"))
    jobs = crawl_queue.discovered_jobs(links, queue, score, now, crawl_queue.DEFAULT_RESCHEDULE_DAYS)
    return reached, jobs
