"""Fingerprints, near duplicates, projection, bucket sums and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..operators import vectors as v
from .base import query

N_FEATURES, DIM, K = 512, 64, 16
# Dictionary weights by rule, so that both engines can make the same ones.
WEIGHT = "CAST((feature_id * 7919 + dim * 104729 + feature_id * dim * 31) % 2003 - 1001 AS DOUBLE) / 25000.0"
DICT_SQL = f"""dict AS (SELECT feature_id, list({WEIGHT} ORDER BY dim) AS w FROM range({N_FEATURES}) f(feature_id), range({DIM}) g(dim) GROUP BY 1),
act AS (SELECT vec_id, feature_id, greatest(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), w) - 0.01, 0.0) AS value FROM embeddings, dict)"""
TOPK_SQL = f"""{DICT_SQL}, topk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, feature_id) AS rank FROM act QUALIFY rank <= {K})"""


def dictionary(t):
    """Feature rows by rule; the work grows with the vectors they are applied to."""
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(DIM - 1)),
        lambda dim: ((F.col("id") * 7919 + dim * 104729 + F.col("id") * dim * 31) % 2003 - 1001).cast("double") / 25000.0,
    )
    return t.spark.range(N_FEATURES).select(
        F.col("id").alias("feature_id"), weights.alias("weights"), F.lit(v.BIAS).alias("bias")
    )


def topk(t):
    return v.project_topk(t.embeddings, dictionary(t), K)


def simhash_sql(source: str, key: str, tag: str) -> str:
    """CTEs that end in ``<tag>sh(key, hi, lo)``: the fingerprints of a table's texts."""
    sums = ", ".join(f"sum((hi >> {i}) & 1) AS h{i}, sum((lo >> {i}) & 1) AS l{i}" for i in range(32))
    high, low = (" + ".join(f"CASE WHEN 2 * {x}{i} >= n THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32)) for x in "hl")
    return f"""{tag}tok AS (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '')) AS w FROM {source}),
{tag}hl AS (SELECT {key}, ('0x' || substr(md5(w), 17, 8))::BIGINT AS hi, ('0x' || substr(md5(w), 25, 8))::BIGINT AS lo FROM {tag}tok),
{tag}bits AS (SELECT {key}, count(*) AS n, {sums} FROM {tag}hl GROUP BY 1),
{tag}sh AS (SELECT {key}, ({high}) AS hi, ({low}) AS lo FROM {tag}bits)"""


SIMHASH_SQL = simhash_sql("documents", "doc_id", "")


@query(
    "simhash",
    f"""WITH {SIMHASH_SQL} SELECT doc_id, CASE WHEN hi >= 2147483648 THEN (hi - 4294967296) * 4294967296 + lo ELSE hi * 4294967296 + lo END::BIGINT AS simhash FROM sh""",
)
def simhash(t):
    return dedup.simhash(t.documents, "doc_id", "text", plain=True)


GREEDY_SQL = f"""WITH RECURSIVE {SIMHASH_SQL},
o AS MATERIALIZED (SELECT doc_id, hi, lo, row_number() OVER (ORDER BY doc_id) AS i FROM sh),
p AS MATERIALIZED (SELECT b.i AS i, list(a.i ORDER BY a.i) AS near FROM o a JOIN o b ON a.i < b.i AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 6 GROUP BY 1),
w AS (SELECT 0::BIGINT AS i, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS by
 UNION ALL SELECT o.i, CASE WHEN x.by IS NULL THEN list_append(w.kept, o.i) ELSE w.kept END, x.by
 FROM w JOIN o ON o.i = w.i + 1 LEFT JOIN p ON p.i = o.i, LATERAL (SELECT list_min(list_intersect(w.kept, p.near)) AS by) x)
SELECT o.doc_id, w.by IS NULL AS kept, CAST(k.doc_id AS VARCHAR) AS near_dup_of FROM w JOIN o ON o.i = w.i LEFT JOIN o k ON k.i = w.by"""


@query("near_dups", GREEDY_SQL)
def near_dups(t):
    out = dedup.near_dups(t.documents, "doc_id", "text", "doc_id")
    return out.select("doc_id", "kept", "near_dup_of")


@query(
    "near_dups_of_benchmark",
    f"""WITH {SIMHASH_SQL}, {simhash_sql("benchmark", "item_id", "b")}
SELECT doc_id, item_id, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM sh a JOIN bsh b
 ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12""",
)
def near_dups_of_benchmark(t):
    docs = dedup.simhash(t.documents, "doc_id", "text", plain=True)
    items = dedup.simhash(t.benchmark, "item_id", "text", plain=True)
    return dedup.hamming_pairs(docs, items, "doc_id", "item_id", max_dist=12)


@query(
    "validate_vectors",
    """SELECT vec_id, CASE WHEN label = 3 THEN 'wrong_dimension' WHEN label = 5 THEN 'not_finite' END AS reject_reason FROM embeddings WHERE label IN (3, 5)""",
)
def validate_vectors(t):
    broken = (
        F.when(F.col("label") == 3, F.slice("embedding", 1, DIM - 1))
        .when(F.col("label") == 5, F.transform("embedding", lambda x, i: F.when(i == 7, F.lit(float("nan")).cast("float")).otherwise(x)))
        .otherwise(F.col("embedding"))
    )
    df = t.embeddings.select("vec_id", broken.alias("embedding"))
    return v.validate_vectors(df, DIM)[1].select("vec_id", "reject_reason")


@query("project", f"WITH {DICT_SQL} SELECT vec_id, feature_id, round(value, 8) AS value FROM act")
def project(t):
    return v.project(t.embeddings, dictionary(t)).withColumn("value", F.round("value", 8))


@query("project_topk", f"WITH {TOPK_SQL} SELECT vec_id, feature_id, CAST(rank AS INTEGER) AS rank, round(value, 8) AS value FROM topk")
def project_topk(t):
    return topk(t).withColumn("value", F.round("value", 8))


@query("project_topk_blocks", f"WITH {TOPK_SQL} SELECT vec_id, feature_id, CAST(rank AS INTEGER) AS rank, round(value, 8) AS value FROM topk")
def project_topk_blocks(t):
    out = v.project_topk(t.embeddings, dictionary(t), K, limit=0)
    return out.withColumn("value", F.round("value", 8))


def gestalt_sql(source: str) -> str:
    sums = ", ".join(
        f"round(coalesce(sum(CASE WHEN feature_id // {N_FEATURES // 8} = {i} THEN value END), 0), 8) AS {p}"
        for i, p in enumerate(v.PILLARS)
    )
    return f"SELECT vec_id, {sums} FROM {source} GROUP BY 1"


def rounded(df):
    return df.withColumns({p: F.round(p, 8) for p in v.PILLARS})


@query("gestalt_sparse", f"WITH {TOPK_SQL} {gestalt_sql('topk')}")
def gestalt_sparse(t):
    return rounded(v.gestalt(topk(t), N_FEATURES))


@query("gestalt_dense", f"WITH {DICT_SQL} {gestalt_sql('act')}")
def gestalt_dense(t):
    return rounded(v.gestalt(v.project(t.embeddings, dictionary(t)), N_FEATURES))


# Twelve named lists; one feature is shared and one does not exist.
CAL_SQL = f"""cal AS (SELECT 'primer' || (i % 12) AS primer, i % 12 AS ordinal, CASE WHEN i = 77 THEN 99999 WHEN i = 80 THEN 3 ELSE i * 5 END AS feature_id FROM range(100) r(i))"""


def calibration(t):
    i = F.col("id")
    feature = F.when(i == 77, 99999).when(i == 80, 3).otherwise(i * 5)
    return t.spark.range(100).select(
        F.concat(F.lit("primer"), (i % 12).cast("string")).alias("primer"), (i % 12).alias("ordinal"), feature.alias("feature_id")
    )


@query(
    "gestalt_calibrated",
    f"WITH {TOPK_SQL}, {CAL_SQL} SELECT vec_id, primer, round(sum(value), 8) AS value FROM topk JOIN cal USING (feature_id) GROUP BY 1, 2",
)
def gestalt_calibrated(t):
    return v.gestalt_calibrated(topk(t), calibration(t)).withColumn("value", F.round("value", 8))


@query(
    "synthesize",
    f"""WITH {TOPK_SQL}, {CAL_SQL}, pr AS (SELECT vec_id, primer, sum(value) AS value FROM topk JOIN cal USING (feature_id) GROUP BY 1, 2),
sz AS (SELECT primer, count(*) AS n FROM cal GROUP BY 1)
SELECT vec_id, feature_id, round(arg_max(value / n, ordinal), 8) AS value FROM pr JOIN cal USING (primer) JOIN sz USING (primer)
WHERE value <> 0 AND feature_id < {N_FEATURES} GROUP BY 1, 2""",
)
def synthesize(t):
    primers = v.gestalt_calibrated(topk(t), calibration(t))
    return v.synthesize(primers, calibration(t), N_FEATURES).withColumn("value", F.round("value", 8))


@query(
    "reconstruct",
    f"""WITH {TOPK_SQL}, u AS (SELECT vec_id, value, unnest(w) AS x, unnest(range({DIM})) AS dim FROM topk JOIN dict USING (feature_id) WHERE value > 0)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(sum(value * x), 8) AS x FROM u GROUP BY 1, 2""",
)
def reconstruct(t):
    out = v.reconstruct(topk(t), dictionary(t))
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 8))


@query(
    "quantize_rows",
    """WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak FROM embeddings),
s AS (SELECT *, CASE WHEN peak > 0 THEN peak / 127.0 ELSE 1.0 END AS scale FROM m)
SELECT vec_id, round(scale, 10) AS scale, array_to_string(list_transform(embedding, lambda x: CAST(least(greatest(sign(x) * floor(abs(x::DOUBLE / scale) + 0.5), -127), 127) AS INTEGER)), ',') AS q FROM s""",
)
def quantize_rows(t):
    out = v.quantize_rows(t.embeddings, "embedding")
    return out.select("vec_id", F.round("scale", 10).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def int8_sql(x: str, scale: str) -> str:
    return f"list_transform({x}, lambda x: least(greatest(sign(x) * floor(abs(x / {scale}) + 0.5), -127), 127))"


PEAK = "list_max(list_transform({0}, lambda x: abs(x)))"
PLANES_SQL = f"""x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
h AS (SELECT *, CASE WHEN {PEAK.format('v')} > 0 THEN {PEAK.format('v')} / 127.0 ELSE 1.0 END AS scale_hi FROM x),
q AS (SELECT *, {int8_sql('v', 'scale_hi')} AS q_hi FROM h),
r AS (SELECT *, list_transform(v, lambda e, i: e - q_hi[i] * scale_hi) AS rest FROM q),
l AS (SELECT *, CASE WHEN {PEAK.format('rest')} > 0 THEN {PEAK.format('rest')} / 127.0 ELSE 1.0 END AS scale_lo FROM r),
planes AS MATERIALIZED (SELECT vec_id, v, q_hi, scale_hi, scale_lo, {int8_sql('rest', 'scale_lo')} AS q_lo FROM l)"""


def numbers_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda x: x::INTEGER), ',')"


@query(
    "quantize_split",
    f"""WITH {PLANES_SQL} SELECT vec_id, round(scale_hi, 10) AS scale_hi, round(scale_lo, 12) AS scale_lo, {numbers_sql('q_hi')} AS q_hi, {numbers_sql('q_lo')} AS q_lo FROM planes""",
)
def quantize_split(t):
    out = v.quantize_split(t.embeddings)
    text = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("q_hi", "q_lo")}
    return out.withColumns(text).select("vec_id", F.round("scale_hi", 10).alias("scale_hi"), F.round("scale_lo", 12).alias("scale_lo"), "q_hi", "q_lo")


INT8_SQL = f"""{DICT_SQL}, {PLANES_SQL},
qd AS MATERIALIZED (SELECT feature_id, scale, {int8_sql('w', 'scale')} AS q FROM
 (SELECT *, CASE WHEN {PEAK.format('w')} > 0 THEN {PEAK.format('w')} / 127.0 ELSE 1.0 END AS scale FROM dict)),
act8 AS (SELECT vec_id, feature_id, greatest((list_dot_product(q_hi, q) * scale_hi + list_dot_product(q_lo, q) * scale_lo) * scale - 0.01, 0.0) AS value FROM planes, qd)"""


@query("project_int8", f"WITH {INT8_SQL} SELECT vec_id, feature_id, round(value, 8) AS value FROM act8")
def project_int8(t):
    return v.project_int8(t.embeddings, dictionary(t)).withColumn("value", F.round("value", 8))


@query(
    "project_int8_topk",
    f"""WITH {INT8_SQL} SELECT vec_id, feature_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, feature_id) AS INTEGER) AS rank, round(value, 8) AS value FROM act8 QUALIFY rank <= {K}""",
)
def project_int8_topk(t):
    return v.rank_topk(v.project_int8(t.embeddings, dictionary(t), k=K), K).withColumn("value", F.round("value", 8))


@query(
    "int8_error",
    f"""WITH {INT8_SQL} SELECT vec_id, round(CASE WHEN max(abs(act.value)) > 0 THEN max(abs(act.value - act8.value)) / max(abs(act.value)) ELSE max(abs(act.value - act8.value)) END, 8) AS relative_error
FROM act JOIN act8 USING (vec_id, feature_id) GROUP BY 1""",
)
def int8_error(t):
    d = dictionary(t)
    out = v.projection_error(v.project(t.embeddings, d), v.project_int8(t.embeddings, d))
    return out.select("vec_id", F.round("relative_error", 8).alias("relative_error"))


@query(
    "rename_pillars",
    f"""WITH {TOPK_SQL}, g AS ({gestalt_sql('topk')}) SELECT vec_id, ontology AS nouns, teleology AS verbs, graph AS prepositions, dimensionality AS adjectives,
 topology AS pronouns, probability AS adverbs, dataset AS conjunctions, human_anomaly AS interjections FROM g""",
)
def rename_pillars(t):
    return v.rename_pillars(rounded(v.gestalt(topk(t), N_FEATURES)), "en")


def coded(t):
    """The eight sums of each whole vector's projection as the eight named floats."""
    return v.float_bits(v.gestalt(v.project(t.embeddings, dictionary(t)), N_FEATURES))


@query("float_hex")
def float_hex(t):
    return v.float_hex(coded(t)).select("vec_id", "symbols", "hex_be", "digest")


@query("glyph")
def glyph(t):
    return v.glyph(coded(t)).select("vec_id", "glyph")


@query("svg_path")
def svg_path(t):
    return v.svg_path(coded(t)).select("vec_id", F.length("svg").alias("n_chars"), F.md5("svg").alias("svg_md5"))
