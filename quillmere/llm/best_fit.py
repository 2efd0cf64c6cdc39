"""Best-fit packing: bounded-space online best fit over the documents of each task.

Every task keeps ``OPEN_BINS`` open sequences in a bitset keyed by their free space: bit f is
set while some open sequence has exactly f tokens left.  A piece of n tokens goes where the
lowest set bit at or above n says, the tightest fit.  When none fits and all places are taken,
the fullest open sequence closes to make room for a new one.  A task holds at most
``OPEN_BINS`` sequences in memory and no document moves between tasks.

What is still open when a task ends is not wasted: such sequences are few, at most
``OPEN_BINS`` a task, and those of ``MERGED_TASKS`` tasks are packed into each other by the
same rule, fullest first and with as many places as they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut_lineage
from .common import documents
from .tokens import WordIds, shared

END_ID = 1
SEQUENCE = 4096
OPEN_BINS = 128  # sequences that a task holds open; at most 2 MB of ids
MERGED_TASKS = 16  # tasks whose last open sequences are packed together: at most 32 MB of ids a group
_ROWS = 4096  # pieces of an Arrow batch

_COLUMNS = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """Open sequences of ``length`` tokens; ``put`` returns the sequences that it closes.

    ``places`` bounds how many are open; None leaves them unbounded.  An item is (n, anything); a
    closed or still open sequence is the list of its items in order.
    """

    def __init__(self, length: int, places: int | None) -> None:
        self.length, self.places, self.count = length, places, 0
        self.bits, self.by_free = 0, {}

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return taken

    def put(self, n: int, item) -> list[list]:
        closed = []
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            into = self._take(free)
        else:
            free, into = self.length, []
            if n < free and self.places is not None and self.count >= self.places:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        into.append((n, item))
        if free == n:
            closed.append(into)
        else:
            self.by_free.setdefault(free - n, []).append(into)
            self.bits |= 1 << (free - n)
            self.count += 1
        return closed

    def rest(self) -> list[list]:
        """The open sequences, fullest first."""
        return [b for free in sorted(self.by_free) for b in self.by_free[free]]


def _packed(docs: DataFrame, length: int, path: str, end_id: int, places: int) -> DataFrame:
    """Pieces by sequence, as tasks close them; ``part`` is the task, ``open`` marks what is left at its end."""

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of, end, bins = shared(WordIds, path), end_id.to_bytes(4, "little"), OpenBins(length, places)
        part, made, rows = TaskContext.get().partitionId(), 0, []

        def lay(sequences: list[list], still_open: bool) -> None:
            nonlocal made
            for items in sequences:
                at = 0
                for n, (doc_id, piece, ids) in items:
                    rows.append((doc_id, piece, piece * length, n, ids, (part << 32) + made, at, part, still_open))
                    at += n
                made += 1

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "part", "open"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(text) + end
                for piece in range(0, -(-len(ids) // (4 * length))):
                    own = ids[4 * length * piece : 4 * length * (piece + 1)]
                    lay(bins.put(len(own) // 4, (doc_id, piece, own)), False)
                    if len(rows) >= _ROWS:
                        yield batch_of()
        lay(bins.rest(), True)
        if rows:
            yield batch_of()

    return documents(docs).mapInArrow(pack, f"{_COLUMNS}, part long, open boolean")


def _merged(left: DataFrame, length: int, tasks: int) -> DataFrame:
    """The sequences left open, those of ``tasks`` neighbouring tasks packed into each other."""

    def merge(table):
        import numpy as np
        import pyarrow as pa

        of, at, n = (table[c].to_numpy() for c in ("sequence_id", "offset", "length"))
        order = np.lexsort((at, of))
        begins = np.flatnonzero(np.diff(of[order], prepend=-1))
        runs = np.split(order, begins[1:])
        fill = np.asarray([int(n[r].sum()) for r in runs])
        bins = OpenBins(length, None)
        sequences = [s for k in np.lexsort((of[order[begins]], -fill)) for s in bins.put(int(fill[k]), runs[k])]
        to, place = np.empty(of.size, np.int64), at.copy()
        for items in sequences + bins.rest():
            base, name = 0, int(of[items[0][1][0]])
            for size, run in items:
                to[run] = name
                place[run] += base
                base += size
        names = [c.split()[0] for c in _COLUMNS.split(", ")]
        new = {"sequence_id": pa.array(to), "offset": pa.array(place)}
        return pa.table([new.get(c, table[c]) for c in names], names)

    # Neighbours by number: at most OPEN_BINS x tasks sequences a group.
    grouped = left.withColumn("group", F.floor(F.col("part") / tasks)).drop("part", "open")
    return grouped.groupBy("group").applyInArrow(merge, _COLUMNS)


def pack(
    docs: DataFrame,
    length: int = SEQUENCE,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    open_bins: int = OPEN_BINS,
    merged_tasks: int = MERGED_TASKS,
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids, sequence_id, offset.

    ids are little-endian unsigned 32-bit numbers and end with ``end_id`` once a document.  Only a
    document of more than ``length`` tokens is cut, into pieces of ``length`` tokens and a last one;
    a very long text is so many full sequences and at most one piece to fit in.  Pieces of a
    sequence lie without gaps from offset 0; sequence ids are unique, not consecutive.

    A null or empty text is its end id alone.  Repeated rows and null ids are packed as they come;
    of equally tight sequences the one touched last is taken.  Other columns are not read; an empty
    table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    made = cut_lineage(_packed(docs, length, path, end_id, open_bins), "best-fit")
    closed = made.filter("NOT open").drop("part", "open")
    return closed.unionByName(_merged(made.filter("open"), length, merged_tasks))


def pieces(docs: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``pack`` with a checksum of each piece in place of its ids."""
    return pack(docs, length).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )
