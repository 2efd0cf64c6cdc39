"""Near duplicates by order MinHash over runs of five words, verified by banded alignment.

A document is the sequence of its five-word runs.  Each run is labelled with its
occurrence, so that repeats count; a sketch takes the two runs of least hash and keeps
them *in text order*, which makes equal sketches follow edit similarity and not only the
set of runs.  Two sketches make a band; documents that agree on a band are candidates.

Texts with the same words form one class first, and one of them stands for it.  In a
bucket of at most ``SMALL`` members all pairs are verified.  A larger bucket is compared
with its hub, the member whose other buckets are the fullest.  Two members that are not
linked to the hub are similar only if they share runs that the hub lacks (or one of them is
shorter than the hub by a few runs), so members are dealt anew by such runs, rarest first
and under a prefix filter; a crowd that shares one gets a hub of its own, and what counts
next are the runs that no hub so far has.  Every member goes on this way.  Members of which
the hubs so far have 0.8 of the runs may be similar without sharing a run beyond them; those
are compared pair by pair in blocks (``among_covered``), unless both are linked to the hub.  How often a crowd
has a run is counted in a table of hashed slots; two runs in one slot only look more frequent,
which may cost a row but loses none.  A crowd is not cut short.  A pair
is a link when the longest common subsequence of the two run sequences, within the only
band that can reach the threshold, is at least 0.8 of their union.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from .common import forget, keep_rows, sha256, stored
from .words import hashed

RUN = 5
SIMILARITY = 0.8
SKETCHES = 24
PER_BAND = 2
SMALL = 8
BLOCK = 128  # members of a crowd in one block of those compared pair by pair
_COLUMNS = 1 << 16  # runs hashed at once
_CHUNK = 16  # bits of a slot inside its part of the table of counts
_SLOTS = 24  # bits of a slot at most; the table takes two bytes a slot


def runs_of(numbers):
    """32-bit hashes of the five-word runs; a shorter text with words is one run."""
    import numpy as np

    w = numbers.astype(np.uint64)
    if not w.size:
        return np.zeros(0, np.uint32)
    k = min(RUN, w.size)
    out = np.full(w.size - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ w[j : w.size - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def _labelled(runs):
    """Each run with its occurrence number mixed in."""
    import numpy as np

    order = np.argsort(runs, kind="stable")
    same = runs[order]
    fresh = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    rank = np.arange(runs.size) - np.repeat(fresh, np.diff(np.concatenate([fresh, [runs.size]])))
    nth = np.empty(runs.size, np.uint64)
    nth[order] = rank
    return runs.astype(np.uint64) + (nth << np.uint64(32))


def bands_of(runs) -> list[int]:
    """One signed 64-bit number for each band of order sketches; none for a text without words."""
    import numpy as np

    if not runs.size:
        return []
    keys, seeds = _labelled(runs), np.random.default_rng(20).integers(1, 1 << 63, SKETCHES, np.uint64)[:, None]
    best = np.full((SKETCHES, 2), np.iinfo(np.uint64).max, np.uint64)
    place = np.full((SKETCHES, 2), -1, np.int64)
    for at in range(0, keys.size, _COLUMNS):
        h = (keys[None, at : at + _COLUMNS] ^ seeds) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        row = np.arange(SKETCHES)
        for _ in range(2):
            k = h.argmin(1)
            best = np.concatenate([best, h[row, k][:, None]], 1)
            place = np.concatenate([place, (at + k)[:, None]], 1)
            h[row, k] = np.iinfo(np.uint64).max
        least = best.argsort(1, kind="stable")[:, :2]
        best, place = np.take_along_axis(best, least, 1), np.take_along_axis(place, least, 1)
    if keys.size == 1:
        place[:, 1] = 0
    place.sort(1)
    pair = runs[place].astype(np.uint64)
    sketch = ((pair[:, 0] << np.uint64(32)) | pair[:, 1]).reshape(-1, PER_BAND)
    out = np.arange(len(sketch)).astype(np.uint64)
    for j in range(PER_BAND):
        out = (out ^ sketch[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64).tolist()


def aligned_similarity(a, b, least: float = SIMILARITY) -> float:
    """Common subsequence over union of two run sequences; 0.0 once it cannot reach ``least``.

    The table of the alignment is kept as the bits of one number.  A cell further from the
    diagonal than the band costs more unmatched runs than a link may have, so it is left out.
    """
    import numpy as np

    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    needed = least / (1 + least) * (n + m)
    if n < needed - 1e-9:
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if np.minimum(ca[ia], cb[ib]).sum() < needed - 1e-9:
        return 0.0
    differ = a != b[:n]
    head = int(differ.argmax()) if differ.any() else n
    differ = a[head:][::-1] != b[head:][::-1][: n - head]
    tail = int(differ.argmax()) if differ.any() else n - head
    a, b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    common = head + tail
    if a and b:
        band = int(n + m - 2 * needed) + 1
        where: dict[int, int] = {}
        for i, x in enumerate(a):
            where[x] = where.get(x, 0) | 1 << i
        full = (1 << len(a)) - 1
        free, window = full, (1 << (2 * band + 1)) - 1
        for j, x in enumerate(b):
            hit = where.get(x)
            if hit:
                low = j - band
                hit &= window << low if low > 0 else window >> -low
                u = free & hit
                if u:
                    free = ((free + u) | (free - u)) & full
        common += len(a) - free.bit_count()
    similarity = common / (n + m - common)
    return similarity if similarity >= least - 1e-9 else 0.0


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words, runs, bands): SHA-256 of the text, hash of its words, runs as bytes, bands."""

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        number = hashed()
        for batch in batches:
            of, runs, bands = [], [], []
            for text in batch.column(2).to_pylist():
                w = number(text)
                r = runs_of(w)
                of.append(xxhash.xxh3_128_hexdigest(w.tobytes()))
                runs.append(r.tobytes())
                bands.append(bands_of(r))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(of, pa.string()),
                    pa.array(runs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "words", "runs", "bands"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha256(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, digest string, words string, runs binary, bands array<long>")


def beyond(runs, base):
    """(the distinct runs outside ``base``, how many of them a prefix needs).

    If a text keeps c of its n runs inside the base, a similar text shares at least 0.8 n of
    them and so 0.8 n - c or more outside, at least one: in any common order of all runs two
    such texts meet before the last that many.  Repeated runs are not left out.
    """
    import numpy as np

    outer, times = np.unique(runs[~np.isin(runs, base)], return_counts=True)
    inside = runs.size - int(times.sum())
    sure = max(1, int(np.ceil(SIMILARITY * runs.size - inside - 1e-9))) if (times == 1).all() else 1
    return outer, max(0, outer.size - sure + 1)


def judged(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """The (a, b) pairs, looked up in (node, runs), that are links."""

    def judge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            good = [
                aligned_similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) > 0
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(runs.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a").join(
        runs.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b"
    )
    return both.select("a", "b", "ra", "rb").mapInArrow(judge, "a long, b long")


def led_by_hubs(star: DataFrame, hubs: DataFrame, runs: DataFrame) -> DataFrame:
    """(star, a, b, linked, outer, room, covered) for (star, a) members and (star, b, rb, base) hubs.

    A member is covered if the base has so many of its runs that it may share none but those with a similar text.
    """

    def judge(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            linked, more, room, covered = [], [], [], []
            for x, y, base in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                base = np.frombuffer(base, np.uint32)
                outer, k = beyond(x, base)
                covered.append(bool(np.isin(x, base).sum() >= SIMILARITY * x.size - 1e-9))
                linked.append(aligned_similarity(x, y) > 0)
                more.append(outer.tobytes())
                room.append(k)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(linked, pa.bool_()), pa.array(more, pa.binary()), pa.array(room, pa.int64()),
                    pa.array(covered, pa.bool_()),
                ],
                ["star", "a", "b", "linked", "outer", "room", "covered"],
            )

    both = star.join(runs.select(F.col("node").alias("a"), F.col("runs").alias("ra")), "a").join(hubs, "star")
    return (
        both.filter("a <> b")
        .select("star", "a", "b", "ra", "rb", "base")
        .mapInArrow(judge, "star long, a long, b long, linked boolean, outer binary, room long, covered boolean")
    )


def among_covered(led: DataFrame, runs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) links between a covered member that the hub is not linked with and any other covered one of its star.

    Such texts need not share a run beyond the base, so no prefix brings them together: the rest that
    is compared pair by pair.  Members are cut into blocks; a task holds two blocks at a time, and
    runs are shuffled once for each block that they meet, not for each pair.
    """
    members = led.filter("covered").select("star", F.col("a").alias("node"), "linked")
    sizes = members.groupBy("star").agg(
        F.ceil(F.count("*") / block).cast("int").alias("all_blocks"), F.ceil(F.count_if(~F.col("linked")) / block).cast("int").alias("open_blocks")
    )
    whole = members.join(sizes.filter("open_blocks > 0"), "star").join(runs, "node")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    near = whole.filter("NOT linked").select(
        "star", place("open_blocks").alias("i"), others("all_blocks").alias("j"), "node", "linked", "runs", F.lit(True).alias("near")
    )
    far = whole.select(
        "star", others("open_blocks").alias("i"), place("all_blocks").alias("j"), "node", "linked", "runs", F.lit(False).alias("near")
    )

    def compare(table):
        import numpy as np
        import pyarrow as pa

        rows = [(r["node"], r["linked"], np.frombuffer(r["runs"], np.uint32), r["near"]) for r in table.to_pylist()]
        found = [
            (a, b)
            for a, _, x, near in rows if near
            for b, known, y, also in rows
            if not also and a != b and (known or a < b) and aligned_similarity(x, y) > 0
        ]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return near.union(far).groupBy("star", "i", "j").applyInArrow(compare, "a long, b long")


def _crowd_keys(star: int, runs):
    """64-bit hashes of the runs of one crowd."""
    import numpy as np

    h = runs.astype(np.uint64) + np.uint64(star * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> np.uint64(33)
        h *= np.uint64(c)
    return h ^ h >> np.uint64(33)


def run_counts(led: DataFrame, bits: int):
    """Two rows of 2 ** bits: members (at most 255) with a run in the slot, and whether one of them is not linked.

    Tasks fold their members first and send the slots in use; the parts of the table are added up apart.
    """

    def tally(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts = np.zeros((2, 1 << bits), np.uint8)
        for batch in batches:
            for star, linked, outer in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                slots, n = np.unique(_crowd_keys(star, np.frombuffer(outer, np.uint32)) >> np.uint64(64 - bits), return_counts=True)
                counts[0, slots] = np.minimum(255, counts[0, slots] + n)
                if not linked:
                    counts[1, slots] = 1
        used = np.flatnonzero(counts[0])
        for part in np.split(used, np.flatnonzero(np.diff(used >> _CHUNK)) + 1) if used.size else ():
            rows = [part[0] >> _CHUNK, (part & (1 << _CHUNK) - 1).astype(np.uint16).tobytes(), counts[:, part].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in rows], ["chunk", "slots", "counts"])

    def add(table):
        import numpy as np
        import pyarrow as pa

        out = np.zeros((2, 1 << min(bits, _CHUNK)), np.uint8)
        for slots, counts in zip(table["slots"].to_pylist(), table["counts"].to_pylist(), strict=True):
            at, (n, unlinked) = np.frombuffer(slots, np.uint16), np.frombuffer(counts, np.uint8).reshape(2, -1)
            out[0, at] = np.minimum(255, out[0, at].astype(np.int64) + n)
            out[1, at] |= unlinked
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([out.tobytes()], pa.binary())})

    import numpy as np

    parts = led.select("star", "linked", "outer").mapInArrow(tally, "chunk long, slots binary, counts binary")
    whole, width = np.zeros((2, 1 << bits), np.uint8), 1 << min(bits, _CHUNK)
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk long, counts binary").toLocalIterator():
        whole[:, r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], np.uint8).reshape(2, -1)
    return whole


def dealt(led: DataFrame, counts, bits: int) -> DataFrame:
    """(node, linked, parent, key) for the prefix of each member: its rarest runs first.

    Runs of one member come before all others and meet nobody, so they are not listed; nor is
    a run of a linked member that only linked ones share, as links among the linked are known.
    """
    shared = led.sparkSession.sparkContext.broadcast(counts)

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        often, unlinked = shared.value
        for batch in batches:
            rows, keys = [], [np.zeros(0, np.uint64)]
            for i, (star, linked, outer, room) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                runs = np.frombuffer(outer, np.uint32)
                key = _crowd_keys(star, runs)
                slot = key >> np.uint64(64 - bits)
                first = np.lexsort((runs, often[slot]))[:room]
                key, slot = key[first], slot[first]
                keys.append(key[unlinked[slot] > 0 if linked else often[slot] > 1])
                rows += [i] * keys[-1].size
            of = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [of.column(1), of.column(2), of.column(0), pa.array(np.concatenate(keys).view(np.int64))],
                ["node", "linked", "parent", "key"],
            )

    return led.select("star", F.col("a").alias("node"), "linked", "outer", "room").mapInArrow(
        deal, "node long, linked boolean, parent long, key long"
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that each node of the (a, b) links is connected with.

    Every round takes the least label among the neighbours and then the label's own label;
    stars, which large groups are, end in two or three rounds.
    """
    both = cut_lineage(edges.union(edges.select("b", "a")).toDF("node", "near").distinct(), "links")
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("near")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("near"), F.col("comp").alias("c")), "near")
        least = seen.groupBy("node").agg(F.min("c").alias("c")).join(labels, "node")
        nearer = least.select("node", F.least("c", "comp").alias("to"), "comp")
        hop = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        after = cut_lineage(
            nearer.join(hop, "to").select("node", F.least("to", "up").alias("comp"), (F.col("comp") > F.least("to", "up")).alias("moved")),
            "labels",
        )
        labels = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            return labels


def crowds(nodes: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, key, n, linked, parent) of shared buckets, (node, runs) of their members) of (node, bands).

    ``full`` has the runs by ``row``; those of nodes alone in all their buckets are left behind.
    """
    banded = nodes.select("node", F.posexplode("bands").alias("band", "own")).select(
        "node", F.xxhash64("band", "own").alias("key")
    )
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    level = cut_lineage(
        banded.join(crowded, "key").select(
            "node", "key", "n", F.lit(False).alias("linked"), F.lit(None).cast("bigint").alias("parent")
        ),
        "near-buckets",
    )
    paired = level.select(F.col("node").alias("row")).distinct()
    # The same plan at every size: a shuffle of the runs, whatever the size of the list.
    runs = cut_lineage(
        full.select("row", "runs").join(paired.hint("merge"), "row", "left_semi").withColumnRenamed("row", "node"),
        "near-runs",
    )
    return level, runs


def links(level: DataFrame, runs: DataFrame, small: int = SMALL) -> DataFrame:
    """Verified (a, b) links among the members of ``crowds``, enough to connect whatever the bands bring together."""
    weight = cut_lineage(level.groupBy("node").agg(F.sum("n").alias("weight")), "near-weights")
    spark, tables, bases, before = runs.sparkSession, [], None, []
    while True:
        few = (
            level.filter(F.col("n") <= small)
            .groupBy("key")
            .agg(F.sort_array(F.collect_list(F.struct("node", "linked"))).alias("m"))
            .select("m", F.posexplode("m").alias("i", "x"))
            .select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
            .filter("NOT (x.linked AND y.linked)")
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
            .distinct()
        )
        many = level.filter(F.col("n") > small)
        heads = many.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h"), F.first("parent").alias("parent"))
        hub = heads.select("key", F.col("h.node").alias("b"), "parent")
        hub = hub.join(runs.select(F.col("node").alias("b"), F.col("runs").alias("rb")), "b")
        if bases is None:
            # Buckets with the same hub are one crowd.
            star = many.join(hub.select("key", F.col("b").alias("star")), "key").select("star", F.col("node").alias("a")).distinct()
            hubs = hub.select(F.col("b").alias("star"), "b", "rb", F.col("rb").alias("base")).dropDuplicates(["star"])
        else:
            # So are the runs of one crowd that bring the same hub.
            hub = hub.withColumn("star", F.xxhash64("parent", "b"))
            star = many.join(hub.select("key", "star"), "key").select("star", F.col("node").alias("a")).distinct()
            hubs = hub.join(bases, "parent").select("star", "b", "rb", F.concat("base", "rb").alias("base")).dropDuplicates(["star"])
        hubs, at_hubs = stored(hubs, "near-hubs")
        led, at_led = stored(led_by_hubs(star, hubs, runs), "near-stars")
        found, _ = stored(judged(few, runs).union(led.filter("linked").select("a", "b")), "near-links")
        tables.append(found)
        last = led.filter("NOT linked").isEmpty()
        if not last:
            tables.append(stored(among_covered(led, runs), "near-covered")[0])
            # Two slots a run, as far as the table may grow.
            total = led.agg(F.sum(F.length("outer"))).first()[0] // 4
            bits = min(_SLOTS, max(_CHUNK, total.bit_length() + 1))
            prefix, at_prefix = stored(dealt(led, run_counts(led, bits), bits), "near-prefixes")
            # Links among the linked are known; a run that only they share need not be looked at.
            open_keys = prefix.groupBy("key").agg(F.count("*").alias("n"), F.min("linked").alias("known")).filter("n > 1 AND NOT known")
            level, at_level = stored(prefix.join(open_keys, "key").select("node", "key", "n", "linked", "parent"), "near-level")
            forget(spark, at_prefix, *before)
            before = [at_hubs, at_level]
            bases = hubs.select(F.col("star").alias("parent"), "base")
            last = level.isEmpty()
        forget(spark, at_led)
        if last:
            return reduce(DataFrame.union, tables)


def near_groups(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc_id, class_id, class_size, n_texts, kept, digest), a row for each document.

    A class is a connected component of links; its id is its largest doc_id, and that row is
    kept.  n_texts counts its different word sequences.  digest is the SHA-256 of the text.

    Null texts count as empty; texts without words are one class; texts of fewer than five
    words are alike only when equal in words; a very long text is sketched and aligned whole.  Of repeated rows with the same id exactly one
    is kept; null ids come last.  Other columns are not read; an empty table gives no rows.
    """
    full, at_full = stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    signed = cut_lineage(full.drop("runs"), "near-rows")
    texts = cut_lineage(
        signed.groupBy("words").agg(F.max("row").alias("node"), F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")),
        "near-texts",
    )
    own = texts.select(F.col("node").alias("row"), "node")
    level, runs = crowds(signed.select("row", "bands").join(own, "row"), full)
    # The runs of all documents are the largest table; only those of shared buckets are needed from here.
    forget(docs.sparkSession, at_full)
    edges = links(level, runs, small)
    comps = components(edges) if not edges.isEmpty() else texts.select("node", F.col("node").alias("comp")).limit(0)
    labelled = texts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = labelled.groupBy("comp").agg(
        F.max("best").alias("top"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")
    )
    by_words = cut_lineage(labelled.select("words", "comp").join(classes, "comp"), "near-classes")
    return signed.select("doc_id", "digest", "row", "words").join(by_words, "words").select(
        "doc_id",
        F.col("top.doc_id").alias("class_id"),
        "class_size",
        "n_texts",
        (F.col("row") == F.col("top.row")).alias("kept"),
        "digest",
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class of near duplicates (see ``keep_rows``)."""
    return keep_rows(docs, cut_lineage(near_groups(docs), "near-answer"))
