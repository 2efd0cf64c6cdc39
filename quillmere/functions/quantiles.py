"""Exact order statistics that survive hot groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

CUTS = 64


def order_statistics(
    df: DataFrame, key: str, value: str, ranks_of: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """(key, n, one column per entry): the value at 0-based rank ``ranks_of[name](n)``.

    Equal values fold into one counted row before the shuffle.  Each group's
    range is then cut by a mergeable quantile sketch; running totals over the
    cuts tell which cut holds each wanted rank, and only those cuts are sorted.
    No group is ever ordered as a whole, and the answer is exact.
    """
    clean = df.select(F.col(key).alias("k"), F.col(value).alias("v")).filter(F.col("v").isNotNull())
    sketch = clean.groupBy("k").agg(
        F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], 1000).alias("cuts"),
        F.count("*").alias("n"),
    )
    counted = clean.groupBy("k", "v").agg(F.count("*").alias("c"))
    slotted = counted.join(sketch, "k")
    slotted = slotted.withColumn("slot", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    sizes = slotted.groupBy("k", "slot").agg(F.sum("c").alias("m"), F.first("n").alias("n"))
    upto = Window.partitionBy("k").orderBy("slot")
    sizes = sizes.withColumn("before", F.sum("m").over(upto) - F.col("m"))
    wanted = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("stat"), fn(F.col("n")).cast("bigint").alias("rank"))
                for name, fn in ranks_of.items()
            ]
        )
    )
    asked = sizes.select("k", "slot", "m", "before", "n", wanted).filter(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("m"))
    )
    needed = asked.select("k", "slot", "before").distinct()
    inside = Window.partitionBy("k", "slot").orderBy("v")
    sorted_cut = (
        slotted.join(needed, ["k", "slot"])
        .withColumn("hi", F.col("before") + F.sum("c").over(inside))
        .withColumn("lo", F.col("hi") - F.col("c"))
    )
    found = sorted_cut.join(asked.select("k", "slot", "stat", "rank"), ["k", "slot"]).filter(
        (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    )
    return found.groupBy("k").agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("stat") == s, F.col("v"))).alias(s) for s in ranks_of],
    ).withColumnRenamed("k", key)


def exact_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, e.g. ``{'q1': 0.25}``."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}__lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"{name}__hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    stats = order_statistics(df, key, value, ranks)
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        pos = (F.col("n") - 1) * F.lit(p)
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.select(key, "n", *out)
