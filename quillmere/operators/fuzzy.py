"""Similarity join on short strings by edit distance, without listing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import spread_small

LONGEST = 100  # code points; longer values belong to the fingerprint operators


def _reach(n: Column, threshold: float) -> Column:
    """Most edits between a string of ``n`` code points and any partner at the threshold."""
    return F.floor(n / threshold + 1e-9).cast("int") - F.ceil(
        threshold * F.floor(n / threshold + 1e-9) - 1e-9
    ).cast("int")


def _shortened(df: DataFrame, name: str, threshold: float) -> DataFrame:
    """(``name``, ``name``_n, key) of a value as it is and, if it may have an edit, without any one of its code points."""
    places = F.sequence(F.lit(0), F.when(_reach(F.col("n"), threshold) > 0, F.col("n")).otherwise(0))
    at = df.select(F.col("v").alias(name), F.col("n").alias(f"{name}_n"), F.explode(places).alias("p"))
    without = F.concat(F.substr(name, F.lit(1), F.col("p") - 1), F.substr(name, F.col("p") + 1))
    # A key only brings values together, so its hash will do; the edit distance decides.
    return at.select(name, f"{name}_n", F.xxhash64(F.when(F.col("p") == 0, F.col(name)).otherwise(without)).alias("key"))


def candidates(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(left, right, n, m) of (v, n) values that may reach the threshold; none that does is missing.

    Where the shorter reach is one edit, equal or once shortened values meet, which a piece that
    all values share does not crowd.  Other pairs meet on pieces.
    """
    once = _reach(F.least("n", "m"), threshold) <= 1
    # The shortest partner has the least reach.
    short = _reach(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), threshold) <= 1
    near = _shortened(spread_small(a.filter(short)), "left", threshold).join(
        _shortened(spread_small(b.filter(short)), "right", threshold), "key"
    )
    near = near.select("left", "right", F.col("left_n").alias("n"), F.col("right_n").alias("m")).filter(once).distinct()
    return near.union(_by_pieces(a, b, threshold).filter(~once).distinct())


def _by_pieces(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(left, right, n, m), repeated, of values that share an unchanged piece; both with a reach above one edit."""
    more = _reach(F.col("n"), threshold) > 1
    a, b = a.filter(more), b.filter(more)
    edits = _reach(F.col("n"), threshold)
    cut = b.withColumn("k", edits + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    begin, end = F.floor(F.col("i") * F.col("n") / F.col("k")), F.floor((F.col("i") + 1) * F.col("n") / F.col("k"))
    pieces = cut.select(
        F.col("v").alias("right"), F.col("n").alias("m"), "i",
        F.substr("v", (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"),
    )
    # Lengths a partner may have, its piece borders, and the shifts that the edits allow.
    sizes = F.sequence(F.ceil(F.col("n") * threshold - 1e-9).cast("int"), F.floor(F.col("n") / threshold + 1e-9).cast("int"))
    by_size = a.withColumn("m", F.explode(sizes)).withColumn("k", _reach(F.col("m"), threshold) + 1)
    by_piece = by_size.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start, stop = F.floor(F.col("i") * F.col("m") / F.col("k")), F.floor((F.col("i") + 1) * F.col("m") / F.col("k"))
    placed = by_piece.withColumns({"s": start.cast("int"), "w": (stop - start).cast("int")})
    low = F.greatest(F.col("s") - F.col("k") + 1, F.lit(0))
    high = F.least(F.col("s") + F.col("k") - 1, F.col("n") - F.col("w"))
    offered = (
        placed.filter(high >= low)
        .withColumn("p", F.explode(F.sequence(low, high)))
        .select(F.col("v").alias("left"), "n", "m", "i", F.substr("v", F.col("p") + 1, F.col("w")).alias("piece"))
        .distinct()
    )
    return offered.join(pieces, ["m", "i", "piece"]).select("left", "right", "n", "m")


def similar_strings(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(left, right, similarity) for the distinct values of two one-column tables.

    similarity is 1 - edits / longer length, at least ``threshold``.  Values with a reach of one
    edit meet on themselves less one code point.  Otherwise a right value is cut into one piece
    more than the edits it may have; some piece then stands unchanged in any partner, shifted by
    no more than those edits.  A left value offers its substrings of just those lengths and
    places, so values meet by equality; the edit distance decides.
    Nulls and empty strings have no partner; values over ``LONGEST`` are refused.
    """
    if not 0.5 <= threshold < 1:
        raise ValueError("threshold is at least 0.5 and below 1")
    values = [
        df.select(F.col(df.columns[0]).cast("string").alias("v")).filter("v <> ''").distinct().withColumn("n", F.length("v"))
        for df in (left, right)
    ]
    for v in values:
        if not v.filter(F.col("n") > LONGEST).isEmpty():
            raise ValueError(f"values of at most {LONGEST} code points")
    longer = F.greatest("n", "m")
    similarity = 1 - F.levenshtein("left", "right") / longer
    return (
        candidates(*values, threshold)
        .withColumn("similarity", similarity)
        .filter(F.col("similarity") >= threshold - 1e-9)
        .select("left", "right", "similarity")
    )
