"""Language identification with bit-sliced Bloom filters of character n-grams.

One array of slots serves all languages: a slot holds a bitmask, bit L being language L's
Bloom filter at that slot.  An n-gram probes three slots, and the AND of their masks is the
set of languages that contain it.  A text's n-grams are counted by language; each count is
corrected for the share of false hits that the fill of the language's bits predicts, and the
largest corrected count decides.

An n-gram enters a language's filter when its frequency there is at least a fifth of its
greatest frequency in any language, so that a stray foreign line does not teach its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut_lineage
from .common import documents, held_out

GRAM = 4
SLOTS = 1 << 20
PROBES = 3
TRAINING_ROWS = 4_000  # texts of each language that the filters are learned from
SHARE = 0.2  # of the greatest frequency in any language
_PART = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def _letters():
    """The letter of each code point below 0x3000, 32 where there is none."""
    import numpy as np

    out = np.arange(0x3000, dtype=np.uint32)
    for i in range(0x3000):
        if not chr(i).isalpha():
            out[i] = 32
    return out


def letter_points(text: str, letters):
    """Code points of the lower-cased letters, with one blank for each stretch of anything else."""
    import numpy as np

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < len(letters)
    out = np.where(low, letters[np.where(low, points, 0)], points)
    if not low.all():
        far, at = np.unique(points[~low], return_inverse=True)
        keep = np.array([c if chr(c).isalpha() else 32 for c in far.tolist()], np.uint32)
        out[~low] = keep[at]
    blank = out == 32
    return out[~(blank & np.concatenate([[False], blank[:-1]]))]


def gram_hashes(text: str, letters):
    """64-bit hashes of all n-grams of the letters, a blank before and after; none without a letter."""
    import numpy as np

    points = letter_points(text, letters)
    if not (points != 32).any():
        return np.zeros(0, np.uint64)
    points = points[int(points[0] == 32) : len(points) - int(points[-1] == 32)]
    points = np.concatenate([np.full(GRAM - 2, 32, np.uint32), points, np.full(GRAM - 2, 32, np.uint32)]).astype(np.uint64)
    n = len(points) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = (h ^ points[j : n + j]) * np.uint64(_ODD)
        h ^= h >> np.uint64(32)
    return h


def slots_of(hashes, probe: int):
    import numpy as np

    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return ((hashes + np.uint64(probe) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Filters:
    """Names in order of their bits, masks of the slots (one uint64 array for each 64 names), false-hit rates."""

    names: list[str]
    masks: list
    false_rate: list[float]
    commonest: int

    def counts(self, hashes):
        """Number of n-grams that each language's filter contains."""
        import numpy as np

        out = np.zeros(len(self.names), np.int64)
        for at in range(0, len(hashes), _PART):
            part = hashes[at : at + _PART]
            probes = [slots_of(part, k) for k in range(PROBES)]
            for w, table in enumerate(self.masks):
                found = table[probes[0]] & table[probes[1]] & table[probes[2]]
                for bit in range(min(64, len(self.names) - 64 * w)):
                    out[64 * w + bit] += np.count_nonzero(found & np.uint64(1 << bit))
        return out

    def decide(self, hashes) -> tuple[str, float]:
        """Language of most corrected hits, and its share of all languages' corrected hits."""
        import numpy as np

        n, f = len(hashes), np.array(self.false_rate)
        true = np.maximum((self.counts(hashes) - n * f) / np.maximum(1 - f, 1e-9), 0)
        if not true.any():
            return self.names[self.commonest], 0.0
        best = int(true.argmax())
        return self.names[best], float(true[best] / true.sum())


def learn(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Filters | None:
    """Filters from (doc_id, text, lang) rows outside the held-out fifth; None if nothing has a language.

    About ``training_rows`` whole texts of each language, picked by a hash of id and text,
    teach the filters; their n-grams are folded in each batch before they are shuffled.
    """
    import numpy as np

    rows = documents(docs, F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    names = sorted(sizes)
    rate = docs.sparkSession.createDataFrame(
        [(n, min(1.0, training_rows / sizes[n])) for n in names], "lang string, rate double"
    )
    share = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    # A row for each language: as many as there are names.
    picked = rows.join(F.broadcast(rate), "lang").filter(share < F.col("rate")).select("lang", "text")

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        letters = _letters()
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in sorted(set(lang)):
                mine = [gram_hashes(texts[i], letters) for i in np.flatnonzero(lang == name)]
                h, n = np.unique(np.concatenate(mine), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    grams = cut_lineage(
        picked.mapInArrow(fold, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
        "grams",
    )
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    number = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "lang string, bit long")
    weighed = (
        grams.join(F.broadcast(totals), "lang")  # a row for each language, twice
        .join(F.broadcast(number), "lang")
        .withColumn("f", F.col("n") / F.col("total"))
    )
    greatest = weighed.groupBy("gram").agg(F.max("f").alias("most"))
    held = weighed.join(greatest, "gram").filter(F.col("f") >= SHARE * F.col("most")).select("gram", "bit")

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bit = batch.column(1).to_numpy(zero_copy_only=False)
            slot = np.concatenate([slots_of(h, k) for k in range(PROBES)])
            word, mask = bit // 64, np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(np.tile(word, PROBES)), pa.array(np.tile(mask, PROBES))], ["slot", "word", "mask"]
            )

    sliced = (
        held.mapInArrow(probe, "slot long, word long, mask long")
        .groupBy("word", "slot")
        .agg(F.bit_or("mask").alias("mask"))
        .toPandas()  # at most SLOTS rows of 24 bytes for each 64 languages
    )
    masks = [np.zeros(SLOTS, np.uint64) for _ in range(-(-len(names) // 64))]
    for w, part in sliced.groupby("word"):
        masks[int(w)][part["slot"].to_numpy()] = part["mask"].to_numpy(np.int64).view(np.uint64)
    fill = [np.count_nonzero(masks[b // 64] & np.uint64(1 << (b % 64))) / SLOTS for b in range(len(names))]
    commonest = max(range(len(names)), key=lambda b: (sizes[names[b]], -b))
    return Filters(names, masks, [f**PROBES for f in fill], commonest)


def predicted(docs: DataFrame, filters: Filters | None) -> Column:
    """struct<lang_pred, score> of the column ``text``; the filters go to every worker once."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(filters) if filters else None)

    @F.pandas_udf("lang_pred string, score double")
    def decide(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letters()
        known = Filters(**shared.value) if shared.value else None
        for texts in parts:
            out = []
            for text in texts:
                h = gram_hashes(text, letters)
                out.append(known.decide(h) if len(h) and known else ("und", 0.0))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return decide(F.coalesce(F.col("text"), F.lit("")))


def identify(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each document.

    ``und`` with score 0 where a text is null or has no letter; where no filter knows any
    n-gram, the commonest language with score 0.  Ties go to the first name.  Null languages
    teach nothing; repeated rows get the same answer; a very long text is read whole, in its own
    row; other columns are not read; an empty table gives no rows.
    """
    rows = documents(docs)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(rows, learn(docs, training_rows)).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
