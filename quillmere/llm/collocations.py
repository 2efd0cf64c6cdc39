"""Phrase collocations: exact phrase counts by double-array tries of Apriori-safe candidates.

One pass reads the texts and writes *blocks* of up to ``BLOCK`` words: a row with a code for each
position (0 breaks a phrase) and a 64-bit key of (lang, word) for each code, then a row for each
code with its word and how often the block has it.  Everything later reads blocks, so a word is
hashed once a block.  Rows of words lie between those of codes, so no batch that is read or group of rows
that is written holds more than a few blocks, however many a task makes.

Candidates, level by level: hashed slots count the phrases of a level whose first and last part
passed the level below, and only slots that reach ``min_count`` stay.  A slot can only look
fuller than a phrase in it, so no phrase that is frequent enough is lost (Apriori); the table
has at most ``2 ** MAX_BITS`` slots whatever the corpus, packed to a bit each before it is sent.

Counting: the longest candidate from each position is a window; its first words are candidates too.
Blocks fold equal windows and deal them by a hash of their first two words into shards of at most
about ``SHARD`` positions.  A task folds equal windows of all blocks as they come, builds the double-array trie of a shard's windows, advances the
states of all of them at once, one word a level, and adds up how many positions come to each state:
as all windows that begin with a phrase are in one shard, these sums are the exact counts.  Every
position is read once and sent once at most, however many candidates there are.  Keys that two
words share would mix counts, so the words are compared and the blocks made anew with another
seed if that happens.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..runtime import cut_lineage, scratch_path
from .common import forget

BLOCK = 1 << 20  # words of a block at most, but for the last text in it
MAX_BITS = 26  # of a table that a task counts in, 64 MB, and of its packed bits, 8 MB
CHUNK = 16  # bits of a slot inside its part of the table
WORDS = 1 << 15  # words of a block that leave Python together
GROUP_BYTES = 16 << 20  # of blocks that are written, and read again, together
FOLD = 1 << 17  # windows of a shard at least between one fold of them and the next
ROWS = 4  # blocks, or rows that come of a block, which enter Python together
_MANY = 8  # children of a node beyond which it is placed alone
SHARD = 1 << 20  # positions whose windows one trie counts at most, on average: about 24 MB
GROUPS = 32  # parts of a language that are ranked apart before its whole
_BREAKS = b".,;:!?\n\x0b\x0c\r"  # fixed values


def _blocks(docs: DataFrame, seed: int) -> DataFrame:
    """A row of a block with its int32 codes and uint64 keys by code, then one (lang, word, path, n) of each code but 0."""

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import xxhash

        to = bytearray(range(256))
        for c in range(ord("A"), ord("Z") + 1):
            to[c] = c + 32
        for c in _BREAKS:
            to[c] = 10
        to[9] = 32

        class Codes(dict):
            """Code of each word of one language in this block; -1 for nothing, 0 for a break."""

            def __init__(self, lang: str) -> None:
                super().__init__({b"": -1, b"\n": 0})
                self.lang = lang

            def __missing__(self, word: bytes) -> int:
                entries.append((self.lang, word))
                self[word] = code = len(entries)
                return code

        names = ["codes", "keys", "lang", "word", "path", "n"]
        entries: list[tuple[str, bytes]] = []
        langs: dict[str, Codes] = {}
        parts: list = []
        size = 0

        def block() -> Iterator:
            nonlocal size
            codes = np.concatenate(parts)
            n = np.bincount(codes, minlength=len(entries) + 1)[1:]
            keys = np.zeros(len(entries) + 1, np.uint64)
            for k, (lang, word) in enumerate(entries, 1):
                tag = lang.encode()
                keys[k] = xxhash.xxh3_64_intdigest(b"%d:%b%b" % (len(tag), tag, word), seed) or 1
            raw = keys.astype("<u8").tobytes()
            named = [
                pa.array([e[0] for e in entries], pa.string()),
                pa.array([e[1] for e in entries], pa.binary()),
                _fixed(keys[1:].astype("<u8"), 1),
                pa.array(n, pa.int64()),
            ]
            bare = [pa.nulls(1, x.type) for x in named]
            yield pa.RecordBatch.from_arrays([pa.array([codes.astype("<i4").tobytes()]), pa.array([raw]), *bare], names)
            for i in range(0, len(entries), WORDS):
                some = [x[i : i + WORDS] for x in named]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some[0]), pa.binary())] * 2, *some], names)
            entries.clear(), langs.clear(), parts.clear()
            size = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunks = text.translate(to).replace(b"\n", b" \n ").split(b" ")
                of = langs[lang] if lang in langs else langs.setdefault(lang, Codes(lang))
                codes = np.fromiter(map(of.__getitem__, chunks), np.int32, len(chunks))
                parts += [codes[codes >= 0], np.zeros(1, np.int32)]
                size += parts[-2].size
                if size >= BLOCK:
                    yield from block()
        if size:
            yield from block()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text).mapInArrow(
        read, "codes binary, keys binary, lang string, word binary, path binary, n bigint"
    )


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Rows of megabytes enter Python a few at a time, in what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), ROWS) if int(before) > 0 else ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _fixed(words, size: int):
    """An Arrow array of byte strings of ``size`` words each."""

    rows = pa.Array.from_buffers(pa.binary(8 * size), words.size // size, [None, pa.py_buffer(words.tobytes())])
    return rows.cast(pa.binary())


def _mixed(a, b):
    """Keys of phrases from the key of all words but the last and the key of the last."""
    import numpy as np

    h = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _holds(bits, hashed):
    """Whether the slots of hashed keys are set in a level's packed bits."""
    import numpy as np

    slot = hashed >> np.uint64(64 - (bits.size * 8).bit_length() + 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _climb(codes, keys, passed: list, upto: int):
    """Positions and hashed keys of the phrases of level ``upto`` whose parts pass the levels below.

    ``passed`` holds for each level the packed bits of its slots.  The third answer has for each
    position the words of the longest phrase below ``upto`` that begins there and passes.
    """
    import numpy as np

    longest, word = np.zeros(codes.size, np.int32), _mixed(keys, np.uint64(0))
    at = np.flatnonzero(codes > 0)
    hashed = word[codes[at]]
    for level, bits in enumerate(passed[: upto - 1], 1):
        if level == 1:
            good = _holds(bits, word)
            good[0] = False
            at = np.flatnonzero(good[codes])
            hashed = word[codes[at]]
        else:
            good = _holds(bits, hashed)
            at, hashed = at[good], hashed[good]
        longest[at] = level
        both = np.flatnonzero(at[1:] == at[:-1] + 1)
        at = at[both]
        # Both parts stand, so the word at at + level is none of the breaks.
        hashed = _mixed(hashed[both], keys[codes[at + level]])
    return at, hashed, longest


def _slots(blocks: DataFrame, passed: list, bits: int, least: int):
    """Packed bits: which of 2 ** bits slots hold ``least`` phrases or more of the level above ``passed``."""
    import numpy as np

    level = len(passed) + 1
    below = blocks.sparkSession.sparkContext.broadcast(passed)  # at most 2 ** MAX_BITS bits a level

    def tally(batches: Iterator) -> Iterator:
        import numpy as np

        counts = np.zeros(0, np.uint8)
        for batch in batches:
            for codes, keys in zip(batch.column(0), batch.column(1), strict=True):
                codes, keys = np.frombuffer(codes.as_buffer(), "<i4"), np.frombuffer(keys.as_buffer(), "<u8")
                if not counts.size:
                    counts = np.zeros(1 << bits, np.uint8)
                if level == 1:
                    slot, of = np.unique(_mixed(keys[1:], np.uint64(0)) >> np.uint64(64 - bits), return_inverse=True)
                    n = np.bincount(of, np.bincount(codes, minlength=keys.size)[1:]).astype(np.int64)
                else:
                    hashed = _climb(codes, keys, below.value, level)[1]
                    slot, n = np.unique((hashed >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                slot = slot.astype(np.int64)
                counts[slot] = np.minimum(255, counts[slot] + n)
        for chunk, part in enumerate(counts.reshape(-1, 1 << CHUNK)):
            used = np.flatnonzero(part)
            if used.size:
                rows = [chunk, used.astype("<u2").tobytes(), part[used].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in rows], ["chunk", "slots", "counts"])

    def add(table):
        import numpy as np

        total = np.zeros(1 << CHUNK, np.int64)
        for slots, counts in zip(table["slots"].to_pylist(), table["counts"].to_pylist(), strict=True):
            total[np.frombuffer(slots, "<u2")] += np.frombuffer(counts, np.uint8)
        packed = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([packed], pa.binary())})

    out, width = np.zeros(1 << bits - 3, np.uint8), 1 << CHUNK - 3
    tallied = blocks.select("codes", "keys").mapInArrow(tally, "chunk long, slots binary, counts binary")
    for r in tallied.groupBy("chunk").applyInArrow(add, "chunk long, bits binary").collect():  # 2 ** bits bits
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    below.destroy()
    return out


def _windows(blocks: DataFrame, filters, max_words: int, shards: int) -> DataFrame:
    """(shard, words, n): the different windows of a block for a shard, their keys word by word (0: none), and how often each comes."""

    def emit(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for codes, keys in zip(batch.column(0), batch.column(1), strict=True):
                codes, keys = np.frombuffer(codes.as_buffer(), "<i4"), np.frombuffer(keys.as_buffer(), "<u8")
                size = _climb(codes, keys, filters.value, max_words + 1)[2]
                at = np.flatnonzero(size > 1)
                if not at.size:
                    continue
                # Code 0 has key 0.
                word = lambda at, k: np.where(size[at] > k, codes[np.minimum(at + k, codes.size - 1)], 0)
                rank, span = codes[at].astype(np.int64), keys.size
                for k in range(1, max_words):
                    if span * keys.size >= 1 << 63:
                        rank = np.unique(rank, return_inverse=True)[1]
                        span = at.size
                    rank, span = rank * keys.size + word(at, k), span * keys.size
                _, one, n = np.unique(rank, return_index=True, return_counts=True)
                words = np.stack([keys[word(at[one], k)] for k in range(max_words)])
                shard = (_mixed(_mixed(words[0], np.uint64(1)), words[1]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard, words, n = shard[order], words[:, order].astype("<u8"), n[order].astype("<u4")
                edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), shard.size]
                parts = list(zip(edges, edges[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[edges[:-1]]),
                        pa.array([words[:, i:j].tobytes() for i, j in parts], pa.binary()),
                        pa.array([n[i:j].tobytes() for i, j in parts], pa.binary()),
                    ],
                    ["shard", "words", "n"],
                )

    return blocks.select("codes", "keys").mapInArrow(emit, "shard long, words binary, n binary")


def double_array(paths: list[bytes]):
    """(words, labels, base, check, accepts) of phrases given as paths of eight bytes a word.

    ``words`` are the sorted keys and ``labels`` their labels, small ones for frequent words.  The root is
    slot 0; the child of slot s by label c is slot t = base[s] + c if check[t] = s.  ``accepts`` gives
    the slot of each path.
    """
    import numpy as np

    sizes = np.asarray([len(p) // 8 for p in paths])
    depth = int(sizes.max())
    return _double_array(np.frombuffer(b"".join(p.ljust(8 * depth, b"\0") for p in paths), "<u8").reshape(-1, depth), sizes)


def _double_array(grid, sizes):
    """``double_array`` of phrases given as rows of keys, of which the first ``sizes`` count; equal rows are one phrase."""
    import numpy as np

    depth = int(sizes.max())
    grid = grid[:, :depth]
    used = np.arange(depth) < sizes[:, None]
    words, inverse, times = np.unique(grid[used], return_inverse=True, return_counts=True)
    labels = np.empty(words.size, np.int64)
    labels[np.argsort(-times, kind="stable")] = np.arange(1, words.size + 1)
    by_place = np.zeros(grid.shape, np.int64)
    by_place[used] = labels[inverse]
    # Nodes by number, level by level; ``up`` and ``by`` are a node's parent and last label.
    up, by, node = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], np.zeros(len(grid), np.int64)
    total, width = 1, words.size + 1
    for k in range(depth):
        here = np.flatnonzero(sizes > k)
        pair, inverse = np.unique(node[here] * width + by_place[here, k], return_inverse=True)
        up.append(pair // width)
        by.append(pair % width)
        node[here] = total + inverse
        total += pair.size
    up, by = np.concatenate(up), np.concatenate(by)
    order = np.lexsort((by[1:], up[1:])) + 1
    parents, starts, counts = np.unique(up[order], return_index=True, return_counts=True)
    base, free = np.zeros(total, np.int64), np.ones(3 * total // 2 + width + 1024, bool)
    free[0] = False
    at = 1
    for p in np.argsort(-counts, kind="stable")[: int((counts > _MANY).sum())]:
        # Nodes with many children, most first: next fit, in ever longer strides.
        own = by[order[starts[p] : starts[p] + counts[p]]]
        off, reach = own - own[0], max(1, min(256, (1 << 18) // own.size))
        stride = reach
        while True:
            if at + reach + off[-1] >= free.size:
                free = np.concatenate([free, np.ones(at + reach + int(off[-1]) - free.size + (1 << 16), bool)])
            tries = at + np.flatnonzero(free[at : at + reach])
            fits = free[tries[:, None] + off].all(1)
            if fits.any():
                break
            at += stride
            stride *= 2
        first = int(tries[fits.argmax()])
        base[parents[p]] = first - own[0]
        free[first + off] = False
    random = np.random.default_rng(11)
    for c in range(_MANY, 1, -1):
        # All nodes with few children propose places at once; who shares none with an earlier one stays.
        todo = np.flatnonzero(counts == c)
        own = by[order[starts[todo][:, None] + np.arange(c)]]
        while todo.size:
            if free.mean() < 0.4 or free.sum() < 1.2 * c * todo.size:
                free = np.concatenate([free, np.ones(free.size // 2, bool)])
            spots = random.integers(0, free.size - width, todo.size)[:, None] + own
            fit = np.flatnonzero(free[spots].all(1))
            first = np.unique(spots[fit], return_index=True)[1]
            won = fit[np.bincount(first // c, minlength=fit.size) == c]
            base[parents[todo[won]]] = spots[won, 0] - own[won, 0]
            free[spots[won]] = False
            left = np.ones(todo.size, bool)
            left[won] = False
            todo, own = todo[left], own[left]
    lone = counts == 1
    spots = np.flatnonzero(free)[: int(lone.sum())]
    base[parents[lone]] = spots - by[order[starts[lone]]]
    slot = base[up] + by
    slot[0] = 0
    size = int(slot.max()) + 1
    out, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    out[slot] = base
    check[slot[1:]] = slot[up[1:]]
    return words, *(x.astype("<i4") for x in (labels, out, check, slot[node]))


def _folded(parts: list):
    """Equal windows of several (windows, times) as one, with the sum of their times."""
    import numpy as np

    grid, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort(grid.T)
    grid, n = grid[order], n[order]
    new = np.ones(n.size, bool)
    new[1:] = (grid[1:] != grid[:-1]).any(1)
    first = np.flatnonzero(new)
    return grid[first], np.add.reduceat(n, first)


def _walked(windows: DataFrame, max_words: int, least: int) -> DataFrame:
    """(path, a) of the phrases of two words or more that ``least`` positions or more of their shard's windows begin with."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        grid, n = np.zeros((0, max_words), np.uint64), np.zeros(0, np.int64)
        parts, held = [], 0
        for batch in batches:
            for keys, times in zip(batch["words"], batch["n"], strict=True):
                parts.append((np.frombuffer(keys.as_buffer(), "<u8").reshape(max_words, -1).T, np.frombuffer(times.as_buffer(), "<u4")))
                held += parts[-1][1].size
            if held >= max(FOLD, n.size):
                grid, n = _folded([(grid, n), *parts])
                parts, held = [], 0
        grid, n = _folded([(grid, n), *parts])
        parts.clear()
        sizes = (grid > 0).sum(1)
        words, labels, base, check, _ = _double_array(grid, sizes)
        at, state, paths, counts = np.arange(n.size), np.zeros(n.size, np.int64), [], []
        for k in range(max_words):
            here = sizes[at] > k
            at, state = at[here], state[here]
            to = base[state] + labels[np.searchsorted(words, grid[at, k])]
            assert (check[to] == state).all()
            state = to
            if k:
                # Sums of doubles are exact up to 2 ** 53.
                sums = np.bincount(state, n[at])
                often = np.flatnonzero(sums[state] >= least)
                found, one = np.unique(state[often], return_index=True)
                paths.append(_fixed(grid[at[often[one]], : k + 1], k + 1))
                counts.append(pa.array(sums[found].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(paths), pa.concat_arrays(counts)], ["path", "a"])

    return windows.groupBy("shard").applyInArrow(walk, "path binary, a long")


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10) -> tuple[DataFrame, DataFrame]:
    """((path, lang, word, n) of every word, (path, a) of every phrase of 2 to ``max_words`` with a >= min_count)."""
    import numpy as np

    spark = docs.sparkSession
    for seed in range(16):
        at_blocks = scratch_path(spark, "phrase-blocks")
        made = _blocks(docs, seed)
        made.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(at_blocks)
        rows = spark.read.schema(made.schema).parquet(at_blocks)
        blocks = rows.filter("codes IS NOT NULL").select("codes", "keys")
        folded = rows.filter("codes IS NULL").groupBy("path", "lang", "word").agg(F.sum("n").alias("n"))
        words = cut_lineage(folded, "phrase-words")
        if words.groupBy("path").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
            break
        forget(spark, at_blocks)
    else:
        raise RuntimeError("no seed tells all words apart")
    positions = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BITS, max(CHUNK, int(positions).bit_length()))
    passed: list[np.ndarray] = []
    with _few_rows(spark):
        for _ in range(max_words):
            passed.append(_slots(blocks, passed, bits, min_count))
        filters = spark.sparkContext.broadcast(passed)  # at most 2 ** MAX_BITS bits a level
        windows = _windows(blocks, filters, max_words, max(1, -(-positions // SHARD)))
        phrases = cut_lineage(_walked(windows, max_words, min_count), "phrase-counts")
    filters.destroy()
    forget(spark, at_blocks)
    return words, phrases


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits: exact for counts below 10^15."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    names = dict(zip("alr", whole, strict=True))
    return F.call_function("div", names["a"] * names["a"] * F.lit(1_000_000).cast("decimal(7,0)"), names["l"] * names["r"])


def collocations(
    docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000, contained_percent: int = 50
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased in A-Z, cut at . , ; : ! ? and line ends, and split at blanks and tabs.
    A phrase of 2 to ``max_words`` words with a >= min_count occurrences inside such pieces is scored
    floor(1000000 a a / (l r)) at its lowest-scoring cut (the first of equal ones), l and r being
    the counts of its parts.  It is left out when a longer such phrase contains it and occurs
    ``contained_percent`` of a times or more.  n counts all words of the language.  Ties in score go by a,
    then by the phrase's bytes.

    Null texts count as empty, a null lang is ``und``; repeated rows count as often as they come;
    ids and other columns are not read; an empty table gives no rows.  A very long text is a block of
    its own, read once; a very long word is a word like any other.
    """
    words, phrases = phrase_counts(docs, max_words, min_count)
    size = F.length("path") / 8
    known = words.filter(F.col("n") >= min_count).select("path", F.col("n").alias("a"), "lang").unionByName(phrases, allowMissingColumns=True)
    cuts = phrases.select("path", "a", F.explode(F.sequence(F.lit(1), (size - 1).cast("int"))).alias("k")).select(
        "path",
        "a",
        "k",
        F.substring("path", F.lit(1), F.col("k") * 8).alias("first"),
        F.substring("path", F.col("k") * 8 + 1, F.length("path")).alias("rest"),
    )
    parts = cuts.join(known.select(F.col("path").alias("first"), F.col("a").alias("l"), "lang"), "first").join(
        known.select(F.col("path").alias("rest"), F.col("a").alias("r")), "rest"
    )
    # The first part of one cut is a word, which has the language.
    scored = parts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))).groupBy("path", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m"), F.max("lang").alias("lang")
    )
    # Where a phrase of L words has a part of w words: every start, w from 2 to L - 1.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), (size - 1).cast("int")),
            lambda w: F.transform(
                F.sequence(F.lit(0), (size - w).cast("int")), lambda i: F.substring(F.col("path"), i * 8 + 1, w * 8)
            ),
        )
    )
    inside = phrases.filter(size > 2).select(F.explode(spans).alias("path"), "a").groupBy("path").agg(F.max("a").alias("whole"))
    alive = scored.join(inside, "path", "left").filter(
        F.col("whole").isNull() | (F.lit(100) * F.col("whole") < F.lit(contained_percent) * F.col("a"))
    )
    # Only what ranks high enough among some of the rows of its language, ties included, is spelled.
    rough = Window.partitionBy("lang", F.pmod(F.xxhash64("path"), F.lit(GROUPS))).orderBy(F.desc("m.score"), F.desc("a"))
    high = cut_lineage(alive.drop("whole").withColumn("rank", F.rank().over(rough)).filter(F.col("rank") <= top).drop("rank"), "phrase-high")
    spelled = (
        high.select("path", F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("i"))
        .withColumn("word_path", F.substring("path", F.col("i") * 8 + 1, F.lit(8)))
        .join(words.select(F.col("path").alias("word_path"), "word"), "word_path")
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("w"))
        .select("path", F.concat_ws(" ", "w.word").alias("phrase"))
    )
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    rows = high.join(spelled, "path").select("lang", "phrase", "a", "m.l", "m.r", "m.score").join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
