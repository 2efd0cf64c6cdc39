"""Language gate from character n-gram profiles that Spark learns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MIN_DETECTABLE = 8
GRAM = 3


PROFILE_GRAMS = 1_000_000  # different grams of a profile that tasks hold: about 40 MB for four languages
WORDS_HELD = 200_000  # words whose gains a task remembers
ROWS_SCORED = 500  # rows whose words are scored together


def _words(text: str) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)(\p{L}+)"), 1)


def _grams(counted: DataFrame, keep: list) -> DataFrame:
    """(keep..., gram, n): n-grams inside (keep..., w, n) counted words, a blank on each side of a word."""
    padded = counted.withColumn("w", F.concat(F.lit(" "), F.col("w"), F.lit(" ")))
    # Every word has at least three characters once padded.
    starts = F.sequence(F.lit(1), F.length("w") - (GRAM - 1))
    return (
        padded.select(*keep, "w", "n", F.explode(starts).alias("s"))
        .select(*keep, F.substring(F.col("w"), F.col("s"), F.lit(GRAM)).alias("gram"), "n")
        .groupBy(*keep, "gram")
        .agg(F.sum("n").alias("n"))
    )


def _counted(df: DataFrame, text: str, keep: list) -> DataFrame:
    return df.select(*keep, F.explode(_words(text)).alias("w")).groupBy(*keep, "w").agg(F.count("*").alias("n"))


def train_language_profiles(
    df: DataFrame, text: str, lang: str
) -> DataFrame:
    """(lang, gram, weight): smoothed log share of every gram that a language has.

    Words are counted before they are cut into grams, so a word is cut once for each language.
    """
    counts = _grams(_counted(df, text, [lang]), [lang])
    totals = counts.groupBy(lang).agg(F.sum("n").alias("total"))
    return counts.join(totals, lang).select(
        F.col(lang).alias("lang"),
        "gram",
        F.log((F.col("n") + 1) / (F.col("total") + 1)).alias("weight"),
    )


def detected_language(words: Column, profiles: DataFrame) -> Column:
    """Best-scoring language of an array of words, null when no gram of theirs is known; scored inside the row.

    Profiles must have at most ``PROFILE_GRAMS`` different grams.
    """
    rows = profiles.select("lang", "gram", "weight").toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    # An unseen gram costs the same in every language, so only hits need summing.
    floor = min(rows["weight"].to_pylist(), default=0.0) - 2.0
    gains: dict[str, list[float]] = {}
    for lang, gram, weight in zip(*(rows[c].to_pylist() for c in ("lang", "gram", "weight")), strict=True):
        gains.setdefault(gram, [0.0] * len(langs))[langs.index(lang)] = weight - floor
    shared = profiles.sparkSession.sparkContext.broadcast((langs, gains))

    @F.arrow_udf("string")
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, gains = shared.value
        none = (0.0,) * len(langs)
        held: dict[str, tuple[float, ...]] = {}

        def gain(word: str) -> tuple[float, ...]:
            if word not in held:
                if len(held) >= WORDS_HELD:
                    held.clear()
                padded = f" {word} "
                found = [gains[g] for i in range(len(word)) if (g := padded[i : i + GRAM]) in gains]
                held[word] = tuple(map(sum, zip(*found, strict=True))) if found else none
            return held[word]

        def best(rows: pa.Array) -> pa.Array:
            # Words meet their gains by code: different words are scored once, and no text becomes Python lists.
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            coded = rows.flatten().dictionary_encode()
            if not len(coded) or not langs:
                return pa.nulls(len(rows), pa.string())
            table = np.array([gain(w) for w in coded.dictionary.to_pylist()])
            codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(rows)), sizes)
            total = np.stack([np.bincount(row, table[codes, i], len(rows)) for i in range(len(langs))], axis=1)
            # Of equal gains the last language in order wins; every known gram gains something.
            picked = len(langs) - 1 - total[:, ::-1].argmax(axis=1)
            return pa.array(langs, pa.string()).take(pa.array(picked, mask=~total.any(axis=1)))

        for batch in batches:
            parts = [best(batch.slice(at, ROWS_SCORED)) for at in range(0, len(batch), ROWS_SCORED)]
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, pa.string())
    return detect(words)


def detect_language(df: DataFrame, key: str, text: str, profiles: DataFrame) -> DataFrame:
    """(key, detected): best-scoring profile; rows with no known gram are absent.

    Profiles of any size: grams meet them by equality, words counted first.
    """
    floor = profiles.agg(F.min("weight") - F.lit(2.0)).scalar()
    grams = _grams(_counted(df, text, [key]), [key])
    hits = grams.join(profiles, "gram")  # the planner measures the profiles
    gains = (
        hits.withColumn("gain", F.col("n") * (F.col("weight") - floor))
        .groupBy(key, "lang")
        .agg(F.sum("gain").alias("gain"))
    )
    best = F.max_by("lang", F.struct("gain", "lang"))
    return gains.groupBy(key).agg(best.alias("detected"))


def language_gate(
    df: DataFrame, key: str, text: str, profiles: DataFrame, wanted: str = "en"
) -> DataFrame:
    """Adds ``detected`` and ``passes``: short or undetectable text always passes.

    Profiles of a measured, bounded size are sent to the tasks and nothing is shuffled; larger ones are joined.
    """
    if profiles.select("gram").distinct().count() <= PROFILE_GRAMS:
        out = df.withColumn("detected", detected_language(_words(text), profiles))
    else:
        out = df.join(detect_language(df, key, text, profiles), key, "left")
    short = F.length(F.coalesce(F.col(text), F.lit(""))) < MIN_DETECTABLE
    ok: Column = short | F.col("detected").isNull() | (F.col("detected") == wanted)
    return out.withColumn("passes", ok)
