"""Packing by concatenation: every token of the corpus gets a global place, then fixed windows cut it.

Pass one encodes each document once and writes its ids with a running offset inside its
task.  Pass two sums the tokens of each task; prefix sums over those totals (a row a task)
give every document its global offset.  A document that crosses a window border gets a
boundary record on both sides.  No document is shuffled and nothing is padded but the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from .common import documents
from .tokens import WordIds, shared

END_ID = 2
SEQUENCE = 4096
ROWS = 500  # documents whose ids leave Python together


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, pos, doc_tokens, ids): ids in order with the end id, pos counted within the part."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of, end = shared(WordIds, path), end_id.to_bytes(4, "little")
        part, pos = TaskContext.get().partitionId(), 0
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids = [ids_of(text) + end for text in batch.column(1).to_pylist()]
            n = [len(x) // 4 for x in ids]
            starts = []
            for k in n:
                starts.append(pos)
                pos += k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([part] * len(ids), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                ["doc_id", "part", "pos", "doc_tokens", "ids"],
            )

    return documents(docs).mapInArrow(encode, "doc_id long, part long, pos long, doc_tokens long, ids binary")


def pack(
    docs: DataFrame, length: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``length`` tokens.

    doc_id, start (ids of the document before the piece), length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.  Sequences are full but for the last.

    A null or empty text is its end id alone; a very long text is cut wherever windows end.  Documents keep
    the order in which they are read, so there are no ties.  Repeated rows and null ids are packed as they
    come; other columns are not read; an empty table gives no rows.
    """
    kept = cut_lineage(encoded(docs, tokenizer, end_id), "packing")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        kept.groupBy("part")
        .agg(F.sum("doc_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    # A row for each task of the first pass, 16 bytes: 16 MB for a million tasks.
    placed = kept.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("pos"))
    size = F.lit(length).cast("long")
    first = F.floor(F.col("at") / size)
    last = F.floor((F.col("at") + F.col("doc_tokens") - 1) / size)

    def piece(seq):
        begin = F.greatest(seq * size, F.col("at"))
        n = F.least((seq + 1) * size, F.col("at") + F.col("doc_tokens")) - begin
        start = begin - F.col("at")
        return F.struct(
            start.alias("start"),
            n.alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"),
            seq.alias("sequence_id"),
            (begin - seq * size).alias("offset"),
        )

    # The slices are taken inside the row, so a long document is not copied once for each piece.
    return placed.select(
        "doc_id", "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("p")
    ).select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def pieces(docs: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``pack`` with a checksum of each piece in place of its ids."""
    return pack(docs, length).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
