"""Exact deduplication against an immutable snapshot with static binary-fuse filters.

The snapshot's distinct digests are dealt to buckets of bounded size and each bucket gets a
binary-fuse filter, built once and never changed.  A new batch is folded to its distinct
digests first (its own duplicates are grouped there), then each digest is screened by its
bucket's filter: what the filter denies is new without a look at the snapshot, what it may
know joins the snapshot's exact entries.  Every group of more than one row is checked byte
by byte with mergeable aggregates: the least and the greatest text of a digest are the same
text, or the digest is split by text.  No pair of rows is ever formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_lineage
from .common import keep_rows, sha256

KEYS_PER_FILTER = 1 << 15
MAX_SEEDS = 64


def _mix(keys, seed: int):
    """Murmur's finalizer over uint64 keys moved by a seed."""
    import numpy as np

    x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(m)
    return x ^ (x >> np.uint64(33))


def _places(hashes, segment: int, segments: int):
    """Three slots of each hash in three consecutive segments."""
    import numpy as np

    first = (hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    low = (hashes & mask, (hashes >> np.uint64(18)) & mask, (hashes >> np.uint64(36)) & mask)
    return np.stack([base + np.uint64(j * segment) + low[j] for j in range(3)], 1).astype(np.int64)


def fuse_shape(n: int) -> tuple[int, int]:
    """(slots in a segment, starting segments) for ``n`` keys with three slots each."""
    if n < 2:
        return 4, 1
    segment = min(1 << 18, 1 << max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    slots = n * max(1.125, 0.875 + 0.25 * math.log(10**6) / math.log(n))
    return segment, max(1, math.ceil(slots / segment) - 2)


def build_fuse(keys) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, fingerprints) of a filter that knows all of the distinct uint64 ``keys``.

    Slots held by one key only are peeled in waves; the fingerprints are then set in the
    opposite order.  A seed whose slots cannot be peeled is given up for the next one.
    """
    import numpy as np

    n = len(keys)
    segment, segments = fuse_shape(n)
    rows = np.arange(n)
    for seed in range(MAX_SEEDS):
        hashes = _mix(keys, seed)
        at = _places(hashes, segment, segments)
        slots = segment * (segments + 2)
        held = np.bincount(at.ravel(), minlength=slots)
        who = np.zeros(slots, np.int64)
        for j in range(3):
            np.bitwise_xor.at(who, at[:, j], rows)
        waves, alone = [], np.flatnonzero(held == 1)
        while alone.size:
            peeled, k = np.unique(who[alone], return_index=True)
            waves.append((peeled, alone[k]))
            for j in range(3):
                np.subtract.at(held, at[peeled, j], 1)
                np.bitwise_xor.at(who, at[peeled, j], peeled)
            near = np.unique(at[peeled])
            alone = near[held[near] == 1]
        if sum(len(w[0]) for w in waves) == n:
            marks = np.zeros(slots, np.uint8)
            for peeled, slot in reversed(waves):
                a = at[peeled]
                marks[slot] = _mark(hashes[peeled]) ^ marks[a[:, 0]] ^ marks[a[:, 1]] ^ marks[a[:, 2]]
            return seed, segment, segments, marks.tobytes()
        if seed % 8 == 7:
            segments += max(1, segments // 8)  # a little room after a run of bad seeds
    raise ValueError("no seed peels these keys: they are not distinct")


def _mark(hashes):
    import numpy as np

    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def may_hold(keys, seed: int, segment: int, segments: int, marks: bytes):
    """Which uint64 keys the filter may know: all of its own, about 1 in 256 of others."""
    import numpy as np

    hashes = _mix(keys, seed)
    at = _places(hashes, segment, segments)
    m = np.frombuffer(marks, np.uint8)
    return _mark(hashes) == (m[at[:, 0]] ^ m[at[:, 1]] ^ m[at[:, 2]])


FILTER = "bucket long, seed int, segment int, segments int, marks binary"


def build_filters(digests: DataFrame) -> DataFrame:
    """A filter for each ``bucket`` of distinct (bucket, key) rows; buckets are bounded by their number."""

    def build(pdf):
        import numpy as np
        import pandas as pd

        keys = np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(pdf["bucket"].iloc[0], *build_fuse(keys))], columns=FILTER.replace(",", "").split()[::2])

    return digests.groupBy("bucket").applyInPandas(build, FILTER)


def screen(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, maybe): whether the filter of a digest's bucket may know it."""

    def ask(new, known):
        import numpy as np
        import pandas as pd

        maybe = np.zeros(len(new), bool)
        if len(known) and len(new):
            f = known.iloc[0]
            keys = new["key"].to_numpy(np.int64).view(np.uint64)
            maybe = may_hold(keys, int(f.seed), int(f.segment), int(f.segments), f.marks)
        return pd.DataFrame({"digest": new["digest"], "maybe": maybe})

    return (
        digests.select("digest", "bucket", "key")
        .groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(ask, "digest string, maybe boolean")
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row a digest; the row that stays has the largest id, then the largest row number."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))


def exact_groups(docs: DataFrame, in_snapshot: Column | None = None, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), a row for each document.

    ``in_snapshot`` says which rows belong to the immutable snapshot; the others are the new
    batch.  The default splits by a hash of the id, so that either role is exercised; the
    result is the same for any split.  ``digest`` maps a text to a string.

    Null texts equal empty ones.  Of equal texts the largest doc_id stays, null ids last; of
    repeated rows with the same id and text exactly one is kept.  A very long text is hashed whole and
    moves once to its bucket.  Other columns are not read; an empty table gives no rows.
    """
    side = in_snapshot if in_snapshot is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    source = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(side, F.lit(False)).alias("old"),
    )
    keyed = cut_lineage(
        source.select("doc_id", "old", digest(F.col("text")).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "exact-keyed",
    )
    known, fresh = _groups(keyed.filter("old")), _groups(keyed.filter("NOT old"))
    buckets = max(1, math.ceil(keyed.count() / KEYS_PER_FILTER))

    def dealt(groups: DataFrame) -> DataFrame:
        key = F.xxhash64("digest")
        return groups.select("digest", key.alias("key"), F.pmod(F.shiftright(key, 32), F.lit(buckets)).alias("bucket"))

    filters = cut_lineage(build_filters(dealt(known)), "exact-filters")
    screened = screen(dealt(fresh), filters)
    fresh = cut_lineage(fresh.join(screened, "digest"), "exact-fresh")
    # Only what a filter may know meets the snapshot's entries; false positives find no partner there.
    merged = (
        known.alias("k")
        .join(fresh.filter("maybe").alias("f"), "digest", "full")
        .select(
            "digest",
            F.greatest(F.col("k.best"), F.col("f.best")).alias("best"),
            (F.coalesce(F.col("k.n"), F.lit(0)) + F.coalesce(F.col("f.n"), F.lit(0))).alias("n"),
        )
    )
    groups = cut_lineage(merged.unionByName(fresh.filter("NOT maybe").select("digest", "best", "n")), "exact-groups")

    texts = source.select(digest(F.col("text")).alias("digest"), "text").join(
        groups.filter("n > 1").select("digest"), "digest", "left_semi"
    )
    differ = cut_lineage(
        texts.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo <> hi").select("digest"),
        "exact-checked",
    )
    out = keyed.join(groups, "digest")
    if differ.isEmpty():
        return _answer(out)
    # Texts that share a digest: the same groups again, by digest and text.
    good = _answer(out.join(differ, "digest", "left_anti"))
    split = cut_lineage(
        source.select("doc_id", digest(F.col("text")).alias("digest"), F.col("text").alias("t"))
        .join(differ, "digest", "left_semi")
        .withColumn("row", F.monotonically_increasing_id()),
        "exact-split",
    )
    own = split.groupBy("digest", "t").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
    return good.unionByName(_answer(split.join(own, ["digest", "t"])))


def _answer(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )


def drop_copies(docs: DataFrame, in_snapshot: Column | None = None) -> DataFrame:
    """``docs`` with one row of each text (see ``keep_rows``)."""
    return keep_rows(docs, cut_lineage(exact_groups(docs, in_snapshot), "exact-answer"))
