"""Registered queries of this package and, where SQL can say it, their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit,
    collocations,
    decontamination,
    exact_dedup,
    html_text,
    language_id,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality,
    token_counts,
    url_filter,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("digest")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pieces(table(spark, sf_dir, "documents"))


OP10_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""

OP11_SQL = r"""
WITH pieces AS MATERIALIZED (
    SELECT coalesce(lang, 'und') AS lang,
           list_filter(string_split_regex(unnest(string_split_regex(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w
    FROM documents
),
f AS MATERIALIZED (
    SELECT lang, array_to_string(p, ' ') AS p, len(p) AS k, count(*)::BIGINT AS a
    FROM (SELECT lang, w[i : i + k - 1] AS p
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) v(k)))
    GROUP BY ALL
),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(p, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
inside AS (
    SELECT lang, part, max(a) AS longer
    FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM c WHERE k = 3)
    GROUP BY lang, part
),
split AS MATERIALIZED (
    SELECT lang, p, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
),
cuts AS (
    SELECT s.lang, s.p, s.a, j, x.a AS l, y.a AS r, (1000000::HUGEINT * s.a * s.a) // (x.a::HUGEINT * y.a) AS score
    FROM split s
    JOIN f x ON x.lang = s.lang AND x.p = s.first
    JOIN f y ON y.lang = s.lang AND y.p = s.rest
),
lowest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
),
ranked AS (
    SELECT lowest.lang, p, lowest.a, l, r, score,
           row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, lowest.a DESC, p) AS rank
    FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.part = lowest.p
    WHERE longer IS NULL OR 100 * longer < 50 * lowest.a
)
SELECT ranked.lang, rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN sizes ON sizes.lang = ranked.lang WHERE rank <= 2000
"""

# crc32 of the id's digits, bit by bit; only its last two bits are needed.
OP12_SQL = r"""
WITH named AS (
    SELECT conv_id AS c, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words
    FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
    SELECT c, list(id ORDER BY turn NULLS FIRST, id) AS t, list(words ORDER BY turn NULLS FIRST, id) AS w,
           xor(list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda crc, b: list_reduce(
                   [xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)),
               4294967295::BIGINT) % 4 AS h
    FROM named GROUP BY c
),
rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w
    FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 20
),
paths AS (
    SELECT c, d, array_to_string(t[1:d], '') AS p, array_to_string(t[1:d - 1], '') AS up,
           CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words, d = len(t) AS ends
    FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
),
nodes AS (
    SELECT p, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS saving,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM paths GROUP BY p
),
kids AS (SELECT up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
sums AS (
    SELECT paths.p, sum(saving) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
    FROM nodes LEFT JOIN kids ON kids.p = nodes.p JOIN paths ON paths.c = nodes.c AND paths.d <= nodes.d
    GROUP BY paths.p
)
SELECT a.c AS conv_id, a.d AS depth, b.c AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a LEFT JOIN nodes b ON a.d > 0 AND b.p = a.up LEFT JOIN kids ON kids.p = a.p JOIN sums ON sums.p = a.p
"""

QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_near_dedup": op3_near_dedup,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_html_text": op6_html_text,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_best_fit": op13_best_fit,
}
ORACLES: dict[str, str] = {
    "op10_exact_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
