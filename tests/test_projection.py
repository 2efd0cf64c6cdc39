"""Projections streamed through stored blocks against plain products."""

import numpy as np
import pytest

from quillmere.operators import vectors as v


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(37, 40)).astype(np.float32)
    x[3] = 0
    w = rng.normal(size=(101, 40)).astype(np.float32)
    w[50] = w[7]  # equal features tie
    w[9] = 0
    ids = np.arange(101) * 3 + 5
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    features = [(int(i), r.tolist(), float(i % 4) / 10 - 0.2) for i, r in zip(ids, w, strict=True)]
    dictionary = spark.createDataFrame(features, "feature_id long, weights array<float>, bias double").repartition(4)
    return x.astype(np.float64), w.astype(np.float64), ids, np.array([f[2] for f in features]), vectors, dictionary


def best(scores, ids, k):
    return {(i, int(ids[j])): s[j] for i, s in enumerate(scores) for j in sorted(range(len(s)), key=lambda j: (-s[j], ids[j]))[:k]}


def rows(df):
    return {(r["vec_id"], r["feature_id"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("block_bytes", [1, 40 * 8 * 7, 1 << 20])
def test_blocks_of_any_size_give_the_same_answer(spark, monkeypatch, data, block_bytes):
    x, w, ids, bias, vectors, dictionary = data
    monkeypatch.setattr(v, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(v, "SCORE_BYTES", 1 << 10)
    want = best(np.maximum(x @ w.T + bias, 0), ids, 9)
    stored = v.store_dictionary(dictionary, block_bytes=block_bytes)
    got = rows(v._streamed(vectors.withColumnRenamed("embedding", "v"), stored, 9))
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
    got = rows(v.project_topk(vectors, dictionary, 9, limit=0).drop("rank"))
    assert got.keys() == want.keys()
    everything = rows(v.project(vectors, dictionary, limit=0))
    assert len(everything) == x.shape[0] * w.shape[0] and everything.keys() == rows(v.project(vectors, dictionary)).keys()


@pytest.mark.parametrize("block_bytes", [40, 40 * 7, 1 << 20])
def test_integer_planes(spark, data, block_bytes):
    x, w, ids, bias, vectors, dictionary = data

    def rounded(m):
        peak = np.abs(m).max(1)
        scale = np.where(peak > 0, peak / 127, 1.0)[:, None]
        t = m / scale
        return (np.sign(t) * np.floor(np.abs(t) + 0.5)).astype(np.int64), scale

    hi, s_hi = rounded(x)
    lo, s_lo = rounded(x - hi * s_hi)
    q, scale = rounded(w)
    scores = np.maximum(((hi @ q.T) * s_hi + (lo @ q.T) * s_lo) * scale.T + bias, 0)
    want = best(scores, ids, 12)
    stored = v.store_dictionary(dictionary, True, block_bytes)
    got = rows(v._streamed(vectors.withColumnRenamed("embedding", "v"), stored, 12))
    assert got == want  # integers first, so not even the last bit depends on the blocks
    assert rows(v.project_int8(vectors, dictionary, k=12)) == want


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for dim in (1, v.EXACT_TERMS, v.EXACT_TERMS + 1, 5000):
        x, w = (rng.choice(np.array([-127, 127], np.int8), size=(n, dim)) for n in (3, 4))
        x[0], w[0] = 127, 127
        assert (v.int8_product(x, w) == x.astype(np.int64) @ w.astype(np.int64).T).all()


def test_neither_side_is_shuffled(data):
    *_, vectors, dictionary = data
    stored = v.store_dictionary(dictionary, True)
    plan = v._streamed(vectors.withColumnRenamed("embedding", "v"), stored, 3)._jdf.queryExecution().executedPlan().toString()
    own = vectors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == own.count("Exchange")


def test_a_held_dictionary_gives_small_pieces(spark, monkeypatch):
    df = spark.range(0, 40, 1, 1).selectExpr("id AS vec_id", "array(double(id), 1.0D) AS embedding")
    features = spark.range(8).selectExpr("id AS feature_id", "array(1.0D, double(id)) AS weights", "0.5D AS bias")
    make = v._long_batch

    def small(vec_ids, ids, values):
        assert values.size <= 16
        return make(vec_ids, ids, values)

    monkeypatch.setattr(v, "_long_batch", small)
    monkeypatch.setattr(v, "LONG_BYTES", 8 * 16)
    got = {(r.vec_id, r.feature_id): r.value for r in v.project(df, features).collect()}
    assert got == {(i, k): i + k + 0.5 for i in range(40) for k in range(8)}
