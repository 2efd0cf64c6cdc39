"""Exact deduplication against plain grouping, for any split and any digest."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import exact_dedup

ROWS = [
    (1, "a"), (2, "b"), (3, "a"), (4, "A"), (5, "a "), (6, None), (7, ""), (None, "a"), (None, None), (None, "z"),
    (8, "b"), (8, "b"), (9, "c" * 100_000), (10, "c" * 100_000), (11, "c" * 99_999 + "d"),
]


def brute(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in same if j is not None]
        out.append((i, max(known) if known else None, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, True) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, digest string, row int, kept boolean").repartition(4)


@pytest.mark.parametrize("split", [None, "true", "false", "doc_id % 3 = 0"])
def test_groups(docs, split):
    got = exact_dedup.exact_groups(docs, None if split is None else F.expr(split)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in got), key=repr) == brute(ROWS)
    kept = [(r.doc_id, r.digest) for r in got if r.kept]
    assert len(kept) == len({t or "" for _, t in ROWS}) == len({d for _, d in kept})


def test_texts_that_share_a_digest_are_told_apart(docs):
    got = exact_dedup.exact_groups(docs, F.expr("doc_id % 2 = 0"), lambda t: F.substring(F.sha2(t, 256), 1, 1)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == [x[:3] for x in brute(ROWS)]
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})


def test_drop_copies_keeps_columns_and_one_row_of_each_text(docs):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(t or "" for t in [r.text for r in rows]) == sorted({t or "" for _, t in ROWS})
    assert {r.doc_id for r in rows if r.text == "a"} == {3}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 40_000])
def test_filter_knows_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
    built = exact_dedup.build_fuse(keys)
    assert exact_dedup.may_hold(keys, *built).all()
    others = rng.integers(1 << 63, 1 << 64, 20_000, np.uint64)
    assert exact_dedup.may_hold(others, *built).mean() < (0.01 if n else 1.1)
    if n > 1000:
        assert len(built[3]) < 1.3 * n
