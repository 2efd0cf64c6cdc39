"""The pipeline, stage by stage, and its registration."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillmere.llm import decontamination, quality
from quillmere.llm.queries import ORACLES, QUERIES

BASE = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = entry.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "near_dedup", "decontamination", "packing"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{BASE}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, BASE).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_do_their_work(spark, stages):
    raw = spark.read.parquet(f"{BASE}/documents.parquet")
    for before, after in zip([raw, *stages], stages[:-1], strict=False):
        assert after.columns == raw.columns and after.subtract(before).count() == 0
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    good = {r.doc_id for r in quality.scored(raw, labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in stages[0].collect()} == good
    text = {r.doc_id: r.text for r in stages[0].collect()}
    largest = {}
    for i, t in text.items():
        largest[t] = max(i, largest.get(t, i))
    assert {r.doc_id for r in stages[1].collect()} == set(largest.values())
    bench = spark.read.parquet(f"{BASE}/benchmark.parquet")
    assert decontamination.contaminations(stages[3], bench).count() == 0
    items = [r.text for r in bench.collect()]
    assert not any(i in r.text for r in stages[3].collect() for i in items)
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, BASE)
    assert got.columns == stages[4].columns and got.count() == stages[4].count()


def test_empty_and_odd_documents(spark):
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 60_000, "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, BASE)
            assert out.columns == docs.columns and out.count() <= docs.count()
