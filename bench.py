"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quillmere.catalog import QUERIES  # noqa: E402
from quillmere.runtime import build_session, scratch_scope  # noqa: E402

HEADLINE = (
    "quality_rank_counts", "field_completeness", "apply_rules", "upsert_overwrite", "duplicate_flag",
    "consistency", "risk_lookups", "scan_summary", "box_stats", "histogram", "error_streaks", "rate_gate",
    "latest_per_key", "expand_frontier", "robots_verdict", "extract_page", "link_edges", "simhash",
    "near_dups", "project_topk", "gestalt_sparse", "mean_pairwise_l2", "best_of_n", "chat_corpus",
    "extract_sections", "language_gate", "reconstruct", "stream_rate_gate", "stream_upsert", "risk_regressor",
    "expand_frontier_to_end", "similar_strings", "stream_near_dups",
)


def large_projection(spark, base: str):
    """1,000 vectors of 2,560 numbers against 131,072 features, the best 64 of each, in int8."""
    from pyspark.sql import functions as F

    from quillmere.operators import vectors as v

    wide = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.transform("embedding", lambda x: x / k)))
    rows = spark.read.parquet(f"{base}/embeddings.parquet").filter("vec_id < 1000").select("vec_id", wide.alias("embedding"))
    dictionary = v.make_dictionary(spark, 131_072, 2_560, 7)
    return v.rank_topk(v.project_int8(rows, dictionary, k=64), 64)


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    # Scratch tables go to one folder of the run, as on a cluster.
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"), **{"spark.checkpoint.dir": scratch})
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with scratch_scope(spark):
            QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    start = time.perf_counter()
    with scratch_scope(spark):
        large_projection(spark, base).write.format("noop").mode("overwrite").save()
    times["project_int8_131072x2560"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_wall", "value": total, "unit": "sec", "queries": times, "sf": base}))


if __name__ == "__main__":
    main()
