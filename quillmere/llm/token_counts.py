"""Token counts as an exact histogram of encoded lengths.

Each task folds its documents to (length, documents) before anything moves, so the
shuffle carries distinct lengths only, whatever the hot source or text.  Totals at or
beyond a length are suffix sums over that histogram: first over blocks of lengths,
then inside each block, so no task ever sees more than one block or one row a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import cut_lineage
from .common import documents
from .tokens import ByteCounts, shared

BLOCK = 4096  # lengths whose suffix sums one task takes


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, docs) folded per batch; a length appears once for each batch that has it."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = shared(ByteCounts, path)
        for batch in batches:
            seen = Counter(map(count, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_pydict(
                {"n_tokens": pa.array(seen.keys(), pa.int64()), "docs": pa.array(seen.values(), pa.int64())}
            )

    return documents(docs).select("text").mapInArrow(fold, "n_tokens long, docs long")


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row for each encoded length that occurs, answering every context limit.

    docs, tokens: documents of just this length and their tokens.  docs_at_least,
    tokens_at_least: suffix sums.  docs_at_most: prefix sum, which finds quantiles.
    truncated_tokens: all tokens left if every document were cut to this length.

    A null text counts as empty, with length 0; a very long text is encoded whole and is a length like
    any other; documents of equal length share its row; repeated rows count as often as they
    come; ids and other columns are not read; an empty table gives no rows.
    """
    # Read twice below; a row for each length, so the written table is small.
    folded = encoded_lengths(docs, tokenizer).groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
    hist = (
        cut_lineage(folded, "lengths")
        .withColumn("tokens", F.col("n_tokens") * F.col("docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK).cast("long"))
    )
    # One row for each 4096 lengths: a few thousand rows even with a text of ten million tokens.
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        hist.groupBy("block")
        .agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "block",
            F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
            F.sum("d").over(Window.partitionBy()).alias("all_docs"),
            F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(blocks, "block")
        .withColumn("docs_at_least", F.col("docs_above") + F.sum("docs").over(inside))
        .withColumn("tokens_at_least", F.col("tokens_above") + F.sum("tokens").over(inside))
        .select(
            "n_tokens",
            "docs",
            "tokens",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_docs") - F.col("docs_at_least") + F.col("docs")).alias("docs_at_most"),
            (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias(
                "truncated_tokens"
            ),
        )
    )


def total_at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row: documents over a context limit and the tokens left when they are cut there."""
    return hist.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("docs")), F.lit(0)).alias("tokens_kept"),
    )


def length_quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the share ``q`` of documents does not exceed; null if none."""
    total = hist.agg(F.max("docs_at_least").alias("all_docs"))
    return (
        hist.join(F.broadcast(total), F.col("docs_at_most") >= F.ceil(F.lit(q) * F.col("all_docs")))  # one row
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
