"""Dictionary projection, top-k, bucket sums, quantization and encodings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.fields import truthy
from ..runtime import scratch_path, spread_small

# The eight sums, in bucket order.
PILLARS = (
    "topology", "probability", "ontology", "teleology",
    "graph", "dataset", "dimensionality", "human_anomaly",
)
# Part-of-speech name of each pillar.
PILLAR_NAMES = {
    "en": {
        "ontology": "nouns", "teleology": "verbs", "graph": "prepositions",
        "dimensionality": "adjectives", "topology": "pronouns", "probability": "adverbs",
        "dataset": "conjunctions", "human_anomaly": "interjections",
    },
    "fr": {
        "ontology": "noms", "teleology": "verbes", "graph": "prepositions",
        "dimensionality": "adjectifs", "topology": "pronoms", "probability": "adverbes",
        "dataset": "conjonctions", "human_anomaly": "interjections",
    },
    "zh": {
        "ontology": "mingci", "teleology": "dongci", "graph": "jieci",
        "dimensionality": "xingrongci", "topology": "daici", "probability": "fushi",
        "dataset": "lianci", "human_anomaly": "tanceci",
    },
}
WEIGHT_SIGMA, BIAS = 0.02, -0.01
BROADCAST_LIMIT = 256 << 20  # bytes of float64 weights a task may hold whole
BLOCK_BYTES = 16 << 20  # of a stored block of the dictionary
LONG_BYTES = 4 << 20  # of the scores that leave a held dictionary together; their rows take some six times that
SCORE_BYTES = 64 << 20  # of the scores of one slice of vectors against one block
EXACT_TERMS = (1 << 24) // (127 * 127)  # products of int8 numbers whose sum is exact in float32, in any order


def validate_vectors(
    df: DataFrame, dim: int, vec: str = "embedding", prompt: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): exact dimension, all finite, prompt not blank."""
    finite = F.forall(
        F.col(vec),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")).cast("float")),
    )
    reason = (
        F.when(F.col(vec).isNull() | (F.size(vec) != dim), "wrong_dimension")
        .when(~F.coalesce(finite, F.lit(False)), "not_finite")
    )
    if prompt:
        reason = reason.when(~truthy(F.trim(prompt)), "blank_prompt")
    tagged = df.withColumn("reject_reason", reason)
    good = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, tagged.filter(F.col("reject_reason").isNotNull())


def make_dictionary(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Random features ``(feature_id, weights, bias)``; each row has its own seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            w = np.stack(
                [np.random.default_rng((seed, i)).normal(0.0, WEIGHT_SIGMA, dim) for i in ids]
            ).astype(np.float32)
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    _lists(w, pa.float32()),
                    pa.array([BIAS] * len(ids), pa.float64()),
                ],
                names=["feature_id", "weights", "bias"],
            )

    return spark.range(n).mapInArrow(rows, "feature_id bigint, weights array<float>, bias double")


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists to a float64 matrix without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, -1)


def _topk(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k largest, value descending then id ascending."""
    k = min(k, values.shape[1])
    # ids ascend along the columns, so a stable sort settles ties by id.
    if k < values.shape[1]:
        bound = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
        keep_i = np.empty((values.shape[0], k), dtype=np.int64)
        for r in range(values.shape[0]):
            above = np.flatnonzero(values[r] > bound[r])
            equal = np.flatnonzero(values[r] == bound[r])[: k - len(above)]
            chosen = np.concatenate([above, equal])
            chosen.sort()
            keep_i[r] = chosen[np.argsort(-values[r, chosen], kind="stable")]
    else:
        keep_i = np.argsort(-values, axis=1, kind="stable")
    return ids[keep_i], np.take_along_axis(values, keep_i, axis=1)


_LONG = "vec_id bigint, feature_id bigint, value double"


def _long_batch(vec_ids: np.ndarray, feature_ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(np.repeat(vec_ids, values.shape[1]), pa.int64()),
            pa.array(feature_ids.ravel(), pa.int64()),
            pa.array(values.ravel(), pa.float64()),
        ],
        names=["vec_id", "feature_id", "value"],
    )


def _scores(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(x @ w.T + b, 0.0)


def _dictionary_shape(dictionary: DataFrame) -> tuple[int, int]:
    row = dictionary.agg(F.count("*").alias("n"), F.max(F.size("weights")).alias("d")).first()
    return row["n"], row["d"] or 0


def _project(df: DataFrame, dictionary: DataFrame, vec: str, k: int | None, limit: int) -> DataFrame:
    """Long activations; per vector only the best ``k`` when given.

    A dictionary whose measured size is within ``limit`` is shipped to every
    task once.  A larger one is stored in blocks that tasks stream through
    (``store_dictionary``).  Vectors are never shuffled, nor is the dictionary beyond its one sort.
    """
    n, dim = _dictionary_shape(dictionary)
    vectors = df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vec).alias("v"))
    vectors = spread_small(vectors)
    if n * dim * 8 <= limit:
        table = dictionary.select("feature_id", "weights", "bias").toArrow()
        ids = table["feature_id"].to_numpy()
        rank = np.argsort(ids, kind="stable")
        w, b = _matrix(table["weights"])[rank], table["bias"].to_numpy()[rank]
        shared = df.sparkSession.sparkContext.broadcast((ids[rank], w, b))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, w, b = shared.value
            for batch in batches:
                step = max(1, LONG_BYTES // (8 * max(1, len(ids))))
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    s = _scores(_matrix(part.column(1)), w, b)
                    vid = part.column(0).to_numpy()
                    if k is None:
                        yield _long_batch(vid, np.broadcast_to(ids, s.shape), s)
                    else:
                        yield _long_batch(vid, *_topk(s, ids, k))

        return vectors.mapInArrow(run, _LONG)

    return _streamed(vectors, store_dictionary(dictionary), k)


@dataclass(frozen=True)
class StoredDictionary:
    """Blocks of features in files that every executor gets once, and that tasks read one block at a time."""

    files: tuple[str, ...]
    int8: bool


def int8_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``quantize_rows`` of a matrix: (int8 rows, scale of each)."""
    peak = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(peak > 0, peak / 127.0, 1.0)
    t = x / scale[:, None]
    return np.clip(np.sign(t) * np.floor(np.abs(t) + 0.5), -127, 127).astype(np.int8), scale


def int8_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``quantize_split`` of a matrix: (hi, scale_hi, lo, scale_lo); rows without a finite peak are zero."""
    peak = np.abs(x).max(axis=1, initial=0.0)
    x = np.where(((peak > 0) & np.isfinite(peak))[:, None], x, 0.0)
    hi, scale_hi = int8_rows(x)
    lo, scale_lo = int8_rows(x - hi * scale_hi[:, None])
    return hi, scale_hi, lo, scale_lo


def store_dictionary(dictionary: DataFrame, int8: bool = False, block_bytes: int = BLOCK_BYTES) -> StoredDictionary:
    """Write (feature_id, weights, bias) in blocks by feature to the shared folder and hand the files to all executors.

    Weights take eight bytes, or one and a scale a row.  Spark copies the files to each executor
    once; an executor that joins later gets them with its first task.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, per_block = [], 0, 0

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows)
            w = _matrix(table["weights"])
            parts = int8_rows(w) if int8 else (w, np.zeros(0))
            ids, bias = table["feature_id"].to_numpy(), table["bias"].to_numpy().astype(np.float64)
            columns = [pa.array([ids[0]], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()]) for x in (ids, *parts, bias))]
            return pa.RecordBatch.from_arrays(columns, ["first", "ids", "weights", "scale", "bias"])

        for batch in batches:
            if batch.num_rows and not per_block:
                per_block = max(1, block_bytes // (max(1, len(batch.column(1)[0])) * (1 if int8 else 8)))
            while batch.num_rows:
                part = batch.slice(0, per_block - size)
                held.append(part)
                size += part.num_rows
                batch = batch.slice(part.num_rows)
                if size == per_block:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    spark = dictionary.sparkSession
    path = scratch_path(spark, "dictionary")
    ordered = dictionary.select("feature_id", "weights", F.col("bias").cast("double").alias("bias"))
    ordered = ordered.repartitionByRange("feature_id").sortWithinPartitions("feature_id")
    ordered.mapInArrow(pack, "first long, ids binary, weights binary, scale binary, bias binary").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted(str(f.getPath()) for f in found if f.getPath().getName().endswith(".parquet"))
    for file in files:
        spark.sparkContext.addFile(file)
    return StoredDictionary(tuple(f.rsplit("/", 1)[1] for f in files), int8)


def _blocks_of(stored: StoredDictionary) -> Iterator[tuple]:
    """(ids, weights, scale, bias) of each block, features ascending; one block in memory."""
    import pyarrow.parquet as pq
    from pyspark import SparkFiles

    # Range partitions are written in order of their features.
    for file in stored.files:
        for group in pq.ParquetFile(SparkFiles.get(file)).iter_batches(batch_size=1, columns=["ids", "weights", "scale", "bias"]):
            ids, w, scale, bias = (group.column(c)[0].as_buffer() for c in range(4))
            ids = np.frombuffer(ids, np.int64)
            w = np.frombuffer(w, np.int8 if stored.int8 else np.float64).reshape(ids.size, -1)
            yield ids, w, np.frombuffer(scale), np.frombuffer(bias)


def int8_product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w.T of int8 matrices as int32, exactly: float32 products over slices too short to round."""
    total = np.zeros((x.shape[0], w.shape[0]), np.int32)
    for at in range(0, x.shape[1], EXACT_TERMS):
        cut = slice(at, at + EXACT_TERMS)
        total += (x[:, cut].astype(np.float32) @ w[:, cut].astype(np.float32).T).astype(np.int32)
    return total


def _streamed(vectors: DataFrame, stored: StoredDictionary, k: int | None) -> DataFrame:
    """Long activations of (vec_id, v) against a stored dictionary; a running top k when ``k`` is given."""

    def scores(x, planes, w, scale, bias) -> np.ndarray:
        if not stored.int8:
            return _scores(x, w, bias)
        hi, scale_hi, lo, scale_lo = planes
        both = int8_product(hi, w) * scale_hi[:, None] + int8_product(lo, w) * scale_lo[:, None]
        return np.maximum(both * scale + bias, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = len(batch.column(1)[0]) if batch.num_rows else 0
            # A block has this many features at most, so slices of vectors have scores of a bounded size.
            per_block = max(1, BLOCK_BYTES // (max(1, width) * (1 if stored.int8 else 8)))
            step = max(64, SCORE_BYTES // (8 * per_block))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                vid, x = part.column(0).to_numpy(), _matrix(part.column(1))
                planes = int8_planes(x) if stored.int8 else None
                best_ids = best = None
                for ids, w, scale, bias in _blocks_of(stored):
                    s = scores(x, planes, w, scale, bias)
                    if k is None:
                        yield _long_batch(vid, np.broadcast_to(ids, s.shape), s)
                        continue
                    own_ids, own = _topk(s, ids, k)
                    if best is not None:
                        # Features ascend from block to block, so the earlier of equal values comes first.
                        own_ids, own = np.concatenate([best_ids, own_ids], 1), np.concatenate([best, own], 1)
                        order = np.argsort(-own, axis=1, kind="stable")[:, :k]
                        own_ids, own = np.take_along_axis(own_ids, order, 1), np.take_along_axis(own, order, 1)
                    best_ids, best = own_ids, own
                if best is not None:
                    yield _long_batch(vid, best_ids, best)

    return vectors.mapInArrow(run, _LONG)


def project(
    df: DataFrame, dictionary: DataFrame, vec: str = "embedding", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """(vec_id, feature_id, value) with value = max(0, w.x + b), all features."""
    return _project(df, dictionary, vec, None, limit)


def rank_topk(features: DataFrame, k: int) -> DataFrame:
    """Best k per vector: value descending, feature ascending; adds ``rank``."""
    order = Window.partitionBy("vec_id").orderBy(F.col("value").desc(), F.col("feature_id").asc())
    return features.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def project_topk(
    df: DataFrame,
    dictionary: DataFrame,
    k: int = 64,
    vec: str = "embedding",
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Top-k activations; the full activation table never exists."""
    return rank_topk(_project(df, dictionary, vec, k, limit), k)


def gestalt(features: DataFrame, n_features: int) -> DataFrame:
    """Eight sums per vector by ``feature_id div (n_features / 8)``."""
    if n_features % len(PILLARS):
        raise ValueError("n_features must be a multiple of 8")
    width = n_features // len(PILLARS)
    bucket = F.floor(F.col("feature_id") / F.lit(width))
    sums = [
        F.coalesce(F.sum(F.when(bucket == i, F.col("value"))), F.lit(0.0)).alias(p)
        for i, p in enumerate(PILLARS)
    ]
    return features.groupBy("vec_id").agg(*sums)


def gestalt_calibrated(features: DataFrame, calibration: DataFrame) -> DataFrame:
    """(vec_id, primer, value): sums over listed features; unknown ones add nothing."""
    return (
        features.join(calibration, "feature_id")
        .groupBy("vec_id", "primer")
        .agg(F.sum("value").alias("value"))
    )


def synthesize(
    primers: DataFrame, calibration: DataFrame, n_features: int, skip_negative: bool = False
) -> DataFrame:
    """Spread each primer evenly over its features; the later primer wins a clash.

    ``primers(vec_id, primer, value)``, ``calibration(primer, ordinal, feature_id)``.
    """
    sizes = calibration.groupBy("primer").agg(F.count("*").alias("n"))
    spread = calibration.join(sizes, "primer")
    live = primers.filter(F.col("value") > 0 if skip_negative else F.col("value") != 0)
    return (
        live.join(spread, "primer")
        .filter((F.col("feature_id") >= 0) & (F.col("feature_id") < n_features))
        .groupBy("vec_id", "feature_id")
        .agg(F.max_by(F.col("value") / F.col("n"), F.col("ordinal")).alias("value"))
    )


def reconstruct(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(vec_id, embedding): sum of value times weights over positive activations.

    Works dimension by dimension: sums are combined before the shuffle, and one
    vector's dimensions are gathered only at the end.
    """
    parts = (
        features.filter(F.col("value") > 0)
        .join(dictionary.select("feature_id", "weights"), "feature_id")
        .select("vec_id", "value", F.posexplode("weights").alias("dim", "w"))
        .groupBy("vec_id", "dim")
        .agg(F.sum(F.col("value") * F.col("w")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return parts.groupBy("vec_id").agg(F.transform(ordered, lambda s: s["x"]).alias("embedding"))


def _half_away(c: Column) -> Column:
    return F.signum(c) * F.floor(F.abs(c) + F.lit(0.5))


def _to_int8(c: Column) -> Column:
    return F.least(F.greatest(_half_away(c), F.lit(-127.0)), F.lit(127.0)).cast("tinyint")


def _peak(c: Column) -> Column:
    return F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))


def quantize_rows(df: DataFrame, vec: str = "weights") -> DataFrame:
    """Symmetric int8 rows: adds ``q`` and ``scale`` (1 for an all-zero row)."""
    peak = _peak(F.col(vec))
    out = df.withColumn("scale", F.when(peak > 0, peak / 127.0).otherwise(1.0))
    return out.withColumn("q", F.transform(vec, lambda x: _to_int8(x.cast("double") / F.col("scale"))))


def quantize_split(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Coarse int8 plane plus an int8 plane of what it misses, each with its scale."""
    peak = _peak(F.col(vec))
    good = F.coalesce((peak > 0) & (peak < F.lit(float("inf"))) & ~F.isnan(peak), F.lit(False))
    out = df.withColumn("scale_hi", F.when(good, peak / 127.0).otherwise(1.0)).withColumn("__g", good)
    zero = F.lit(0).cast("tinyint")
    out = out.withColumn(
        "q_hi",
        F.transform(
            vec, lambda x: F.when(F.col("__g"), _to_int8(x.cast("double") / F.col("scale_hi"))).otherwise(zero)
        ),
    ).withColumn(
        "__r",
        F.zip_with(
            vec, "q_hi",
            lambda x, q: F.when(F.col("__g"), x.cast("double") - q * F.col("scale_hi")).otherwise(0.0),
        ),
    )
    rest = _peak(F.col("__r"))
    out = out.withColumn("scale_lo", F.when(rest > 0, rest / 127.0).otherwise(1.0))
    out = out.withColumn("q_lo", F.transform("__r", lambda r: _to_int8(r / F.col("scale_lo"))))
    return out.drop("__g", "__r")


def project_int8(
    df: DataFrame, dictionary: DataFrame, vec: str = "embedding", k: int | None = None
) -> DataFrame:
    """Projection from the quantized planes and the quantized dictionary, in integers.

    value = max(0, (hi . q * scale_hi + lo . q * scale_lo) * scale + b), where both products of int8 rows are summed
    exactly to int32.  The stored dictionary takes a byte a weight and is streamed, whatever
    its size; per vector only the best ``k`` are returned when given.
    """
    vectors = spread_small(df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vec).alias("v")))
    return _streamed(vectors, store_dictionary(dictionary, int8=True), k)


def projection_error(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Largest gap relative to the largest exact activation of each vector."""
    both = exact.withColumnRenamed("value", "e").join(
        approx.withColumnRenamed("value", "a"), ["vec_id", "feature_id"]
    )
    gap = F.max(F.abs(F.col("e") - F.col("a")))
    peak = F.max(F.abs("e"))
    return both.groupBy("vec_id").agg(
        F.when(peak > 0, gap / peak).otherwise(gap).alias("relative_error")
    )


def rename_pillars(df: DataFrame, lang: str) -> DataFrame:
    return df.withColumnsRenamed(PILLAR_NAMES[lang])


def float_bits(df: DataFrame, columns: tuple[str, ...] = PILLARS) -> DataFrame:
    """Adds ``bits``: the eight floats' 32-bit patterns, by an Arrow reinterpretation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            m = np.stack([c.to_numpy(zero_copy_only=False) for c in cols], axis=1).astype("<f4")
            words = m.view("<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(words, pa.int64())], names=[*batch.schema.names, "bits"]
            )

    out = T.StructType([*df.schema.fields, T.StructField("bits", T.ArrayType(T.LongType()))])
    return df.mapInArrow(run, out)


def _hex8(c: Column) -> Column:
    return F.lpad(F.hex(c), 8, "0")


def float_hex(df: DataFrame) -> DataFrame:
    """Adds ``symbols`` (upper, blank-joined), ``hex_be`` (lower, joined), ``digest``.

    The digest is the sha256 of the floats packed little-endian.
    """
    big = F.array_join(F.transform("bits", lambda b: F.lower(_hex8(b))), "")
    flipped = F.transform(
        "bits",
        lambda b: F.concat(*[F.substring(_hex8(b), i, 2) for i in (7, 5, 3, 1)]),
    )
    return df.withColumns(
        {
            "symbols": F.array_join(F.transform("bits", _hex8), " "),
            "hex_be": big,
            "digest": F.sha2(F.unhex(F.array_join(flipped, "")), 256),
        }
    )


def glyph(df: DataFrame) -> DataFrame:
    """Adds ``glyph``: 16 rows of 16 marks, two rows per float, high half first."""
    def rows(b: Column) -> Column:
        marks = F.translate(F.lpad(F.bin(b), 32, "0"), "01", "░█")
        return F.concat(F.substring(marks, 1, 16), F.lit("\n"), F.substring(marks, 17, 16), F.lit("\n"))

    return df.withColumn("glyph", F.array_join(F.transform("bits", rows), ""))


def svg_path(df: DataFrame, offset_x: int = 0, scale: int = 20, pad_y: int = 100) -> DataFrame:
    """Adds ``svg``: a dot per set bit with strokes to set right and lower neighbours.

    Each row is a bounded 8 x 32 grid, walked inside one expression.
    """
    grid = F.transform("bits", lambda b: F.lpad(F.bin(b), 32, "0"))
    rows = len(PILLARS)

    def cell(r: Column, c: Column) -> Column:
        on = lambda rr, cc: F.substring(F.get(F.col("__grid"), rr), cc + 1, F.lit(1)) == "1"
        num = lambda v: v.cast("string")
        x, y = num(F.lit(offset_x) + c * scale), num(F.lit(pad_y) + r * scale)
        nx, ny = num(F.lit(offset_x) + (c + 1) * scale), num(F.lit(pad_y) + (r + 1) * scale)
        stroke = lambda a, b: F.concat(F.lit("M "), x, F.lit(" "), y, F.lit(" L "), a, F.lit(" "), b, F.lit(" "))
        right = F.when((c < 31) & on(r, c + 1), stroke(nx, y)).otherwise("")
        down = F.when(
            (r < rows - 1) & F.coalesce(on(r + 1, c), F.lit(False)),
            F.concat(stroke(x, y), stroke(x, ny)),
        ).otherwise("")
        return F.when(on(r, c), F.concat(stroke(x, y), right, down)).otherwise("")

    cells = F.transform(
        F.sequence(F.lit(0), F.lit(rows * 32 - 1)),
        lambda i: cell(F.floor(i / 32).cast("int"), F.pmod(i, F.lit(32)).cast("int")),
    )
    return df.withColumn("__grid", grid).withColumn("svg", F.array_join(cells, "")).drop("__grid")
