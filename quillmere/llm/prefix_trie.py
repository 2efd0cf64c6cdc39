"""Prefix trie of conversations as a burst trie.

A turn is its id, 16 bytes of a digest of role and text, and its number of words; equal
conversations are one string with a weight.  At first one container under the root holds all
strings.  A container whose suffixes hold more than ``BURST`` turns is burst: the prefix that all
its strings share goes into the trie above it, and the strings are dealt by their next turn id
into containers one level further down.  Each round moves oversized containers only.

What remains is sorted by Spark inside partitions and swept once: a stack of open nodes follows
the common prefixes of neighbouring strings, so a task holds the nodes of one container.  A
container also sends a row for each node on its head's path; these few rows are added up to the
nodes above the containers.  Digests of the conversations that end at a node are folded from
runs of sorted ids, so the ids of a large group of copies are sorted by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut_lineage, scratch_path

BURST = 8_192  # turns below a head that one container may hold
WORD = r"[^\x20\x09-\x0D]+"
_IDS = 65_536  # conversation ids of a run that is hashed at once

_NODE = (
    "head binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved long, ends string"
)
_SWEPT = _NODE + ", up binary, container long, bottom boolean, suffix_words long, below_words long, words long"


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) pairs apart; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def shared_turns(conv_id: Column, most: int) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % most).cast("int")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): each conversation behind the first turns of its family's first one.

    The turns of a conversation are a row of 20 bytes a turn; one shuffle by family
    brings the conversations and the turns they take over together.
    """
    base = (F.col("conv_id") - F.col("conv_id") % family).alias("base")
    ids = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("words"),
    )
    # Nulls come first in an ascending sort; equal turn numbers go by their id.
    dealt = ids.withColumn("base", base).repartition("base")
    own = dealt.groupBy("base", "conv_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "id", "words"))), lambda t: F.struct(t["id"], t["words"])
        ).alias("own")
    )
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, most - 1)), True)
    lent = own.withColumn("lent", head.over(Window.partitionBy("base")))
    h = shared_turns(F.col("conv_id"), most)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    none = F.array().cast("array<struct<id:binary,words:int>>")
    return lent.select("conv_id", F.concat(F.when(h > 0, F.slice(F.coalesce("lent", none), F.lit(1), h)).otherwise(none), rest).alias("turns"))


def _joined_digests(members: DataFrame) -> DataFrame:
    """(string, ends) of (string, conv_id): SHA-256 of the string's ids in order, comma-joined."""

    def runs(batches: Iterator) -> Iterator:
        import pyarrow as pa

        string, first, ids = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["string", "first", "ids"])

        for batch in batches:
            rows: list[tuple] = []
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (s != string or len(ids) >= _IDS):
                    rows.append((string, first, ",".join(map(str, ids))))
                    ids = []
                if not ids:
                    string, first = s, c
                ids.append(c)
            if rows:
                yield batch_of(rows)
        if ids:
            yield batch_of([(string, first, ",".join(map(str, ids)))])

    def digests(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        string, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s == string:
                    state.update(b",")
                else:
                    if state:
                        done.append((string, state.hexdigest()))
                    string, state = s, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["string", "ends"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([string]), pa.array([state.hexdigest()])], ["string", "ends"])

    sorted_ids = members.select("string", "conv_id").repartitionByRange("string", "conv_id").sortWithinPartitions("string", "conv_id")
    pieces = sorted_ids.mapInArrow(runs, "string binary, first long, ids string")
    return pieces.repartition("string").sortWithinPartitions("string", "first").mapInArrow(digests, "string binary, ends string")


def strings(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, ends, ids, words): each different sequence once, under its least conversation."""
    spelled = F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), "")
    named = cut_lineage(conversations.withColumn("string", F.unhex(F.md5(spelled.cast("binary")))), "trie-conversations")
    groups = named.groupBy("string").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    folded = groups.join(_joined_digests(named), "string").drop("string")
    return named.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")).join(folded, "conv_id")


def burst(rows: DataFrame, most: int = BURST) -> DataFrame:
    """``rows`` with ``container`` (a conversation of it) and ``depth`` (turns of its head).

    Rounds end when no container is oversized: a round takes the whole shared prefix of a
    container and the turn behind it, so each one splits every container that it touches.
    """
    spark = rows.sparkSession
    done = scratch_path(spark, "trie-containers")
    cost = F.size("ids") - F.col("depth") + 1
    total = rows.agg(F.sum(F.size("ids") + 1), F.min("conv_id")).first()
    start = rows.withColumn("depth", F.lit(0)).withColumn("container", F.lit(total[1]).cast("long"))
    if (total[0] or 0) <= most:
        return start
    level = start
    while True:
        same = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), False)
        prefixes = cut_lineage(
            level.groupBy("container").agg(F.min("ids").alias("low"), F.max("ids").alias("high")).select(
                "container", F.when(same > 0, same - 1).otherwise(F.size("low")).cast("int").alias("shared")
            ),
            "trie-prefixes",
        )
        keyed = level.join(prefixes, "container").withColumn("next", F.get("ids", F.col("shared")))
        # A string that ends where the others part is a container of its own, without a next turn.
        depth = F.col("shared") + F.when(F.col("next").isNull(), 0).otherwise(1)
        keyed = keyed.withColumn("depth", depth).drop("shared")
        parted = cut_lineage(
            keyed.groupBy("container", "next").agg(
                F.min("conv_id").alias("to"), F.sum(cost).alias("turns"), F.count("*").alias("strings")
            ),
            "trie-parted",
        )
        to = parted.select(F.col("container").alias("c"), F.col("next").alias("x"), "to", (F.col("turns") > most).alias("large"), "strings")
        moved = keyed.join(to, (F.col("container") == F.col("c")) & F.col("next").eqNullSafe(F.col("x")))
        moved = moved.withColumn("again", F.col("large") & (F.col("strings") > 1)).select(*rows.columns, "depth", F.col("to").alias("container"), "again")
        written = cut_lineage(moved, "trie-level")
        written.filter("NOT again").drop("again").write.mode("append").parquet(done)
        level = written.filter("again").drop("again")
        if level.isEmpty():
            return spark.read.schema(start.schema).parquet(done)


def _swept(contained: DataFrame) -> DataFrame:
    """Nodes below the heads, complete but for the parent of top ones, and a row for each node on a head's path.

    The latter have ``container``; ``bottom`` marks the head itself.
    """

    def sweep(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        types = (
            pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
            pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
        )
        names = [c.split()[0] for c in _SWEPT.split(", ")]
        nothing = hashlib.sha256().hexdigest()
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types, strict=True)], names)
            rows.clear()
            return out

        def prefix(ids: list[bytes], upto: int) -> list[bytes]:
            """A key for each prefix of 0 to ``upto`` turns."""
            state, keys = hashlib.blake2b(digest_size=16), []
            for k in range(upto + 1):
                keys.append(state.digest())
                if k < upto:
                    state.update(ids[k])
            return keys

        class Node:
            __slots__ = ("conv", "n", "children", "leaves", "saved", "words", "ends", "parent", "depth")

            def __init__(self, depth: int, words: int, parent) -> None:
                self.depth, self.words, self.parent = depth, words, parent
                self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None

        def container_rows(name: int, depth: int, path: list, nodes: list, top: Node, words: list, suffix: list[int]) -> None:
            """The top is the head; nodes come in the order in which they were opened, parents first."""
            below = sum(v.words for v in nodes)
            for v in reversed(nodes):
                if not v.children:
                    v.leaves = 1
                v.saved += (v.n - 1) * v.words
                up = v.parent
                up.n += v.n
                up.conv = v.conv if up.conv is None else min(up.conv, v.conv)
                up.children += 1
                up.leaves += v.leaves
                up.saved += v.saved
            keys = prefix(path, depth)
            for v in nodes:
                first = v.parent is top
                rows.append((
                    keys[depth] if first else None, v.depth, v.conv, None if first else v.parent.conv, v.n, v.children, v.leaves,
                    v.saved, v.ends or nothing, None, None, None, None, None, None,
                ))
            for d in range(depth + 1):
                at_head = d == depth
                rows.append((
                    keys[d], d, top.conv, None, top.n, top.children if at_head else 0, top.leaves, 0,
                    top.ends if at_head else None, keys[d - 1] if d else None, name, at_head, suffix[d], below,
                    words[d - 1] if d else 0,
                ))

        name = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            for container, depth, conv, n, ends, ids, words in zip(*columns, strict=True):
                if container != name:
                    if name is not None:
                        container_rows(name, head, path, nodes, top, head_words, suffix)
                        if len(rows) >= 4096:
                            yield batch_of()
                    name, head, path, head_words = container, depth, ids, words
                    top, nodes, stack, before = Node(depth, 0, None), [], [], []
                    suffix = [0] * (depth + 1)
                common = head
                while common < min(len(before), len(ids)) and before[common] == ids[common]:
                    common += 1
                del stack[common - head :]
                for k in range(common, len(ids)):
                    v = Node(k + 1, words[k], stack[-1] if stack else top)
                    stack.append(v)
                    nodes.append(v)
                end = stack[-1] if stack else top
                end.n += n
                end.conv = conv if end.conv is None else min(end.conv, conv)
                end.ends = ends
                total = sum(words[head:])
                for d in range(head, -1, -1):
                    total += words[d - 1] if d else 0
                    suffix[d] += n * total
                before = ids
        if name is not None:
            container_rows(name, head, path, nodes, top, head_words, suffix)
        if rows:
            yield batch_of()

    columns = ("container", "depth", "conv_id", "n", "ends", "ids", "words")
    ordered = contained.select(*columns).repartition("container").sortWithinPartitions("container", "ids")
    return ordered.mapInArrow(sweep, _SWEPT)


def prefix_nodes(conversations: DataFrame, most: int = BURST) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns) conversations; see ``conversation_trie``."""
    swept = cut_lineage(_swept(burst(cut_lineage(strings(conversations), "trie-strings"), most)), "trie-swept")
    parts = swept.filter("container IS NOT NULL").withColumnRenamed("head", "key")
    heads = cut_lineage(
        parts.groupBy("key").agg(
            F.first("depth").alias("depth"),
            F.first("up").alias("up"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("below"),
            F.max("ends").alias("ends"),
        ),
        "trie-heads",
    )
    kids = heads.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("heads_below"))
    parents = heads.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    heads = cut_lineage(
        heads.join(kids, "key", "left")
        .withColumn("n_children", F.col("below") + F.coalesce("heads_below", F.lit(0)))
        .join(parents, "up", "left")
        .select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends"),
        "trie-heads",
    )
    # A node on many paths counts its words once, with the container that holds its least conversation.
    known = heads.select("key", F.col("conv_id").alias("least"), "n_children")
    mine = parts.drop("n_children").join(known, "key")
    down = Window.partitionBy("container").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("conv_id") == F.col("least"), F.col("words")).otherwise(0)
    bare = F.when(F.col("bottom") & (F.col("n_children") == 0), 1).otherwise(0)
    sums = (
        mine.select(
            "key",
            (F.col("n_leaves") + F.sum(bare).over(down)).alias("n_leaves"),
            (F.col("suffix_words") - F.col("below_words") - F.sum(own).over(down)).alias("saved"),
        )
        .groupBy("key")
        .agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    above = heads.join(sums, "key").withColumn("ends", F.coalesce("ends", nothing)).select(*columns)
    below = swept.filter("container IS NULL")
    tops = below.filter("head IS NOT NULL").drop("parent_conv_id")
    tops = tops.join(heads.select(F.col("key").alias("head"), F.col("conv_id").alias("parent_conv_id")), "head")
    return above.unionByName(tops.select(*columns)).unionByName(below.filter("head IS NULL").select(*columns))


def conversation_trie(turns: DataFrame, most: int = BURST) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    ``turns`` has conv_id, turn, role, text.  Conversations are rebuilt behind the first turns of the
    first of their twenty (``rebuilt``); a node is a different sequence of first turns.  saved_tokens: the
    words that storing each prefix once saves in the node's subtree.  ends_sha256: of the ids, ascending
    and comma-joined, of the conversations that are just this sequence.

    A null role or text counts as empty; a null turn comes first; equal turn numbers, repeated rows too,
    go by a digest of role and text and all stay.  Rows without conv_id name no conversation and are
    left out.  A very long text is hashed in the scan and never moved; a very long
    conversation is one string.  Other columns are not read; an empty table gives no rows.
    """
    nodes = prefix_nodes(rebuilt(turns), most)
    return nodes.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )
