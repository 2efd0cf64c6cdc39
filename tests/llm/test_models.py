"""Quality, language and URL models: accuracy on held-out rows, and their counts against plain versions."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import language_id, quality, url_filter

BASE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{BASE}/labels.parquet")


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_ranks_held_out_rows(docs, labels):
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    good = np.array([got[i].score for i, q in truth.items() if q == 1 and got[i].held_out])
    bad = np.array([got[i].score for i, q in truth.items() if q == 0 and got[i].held_out])
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (good >= 0.3).mean() > 0.9 and (bad < 0.3).mean() > 0.7


def test_expression_equals_the_model(spark, docs, labels):
    rows = quality.figure_table(docs)
    model = quality.fit(rows, labels)
    for r in rows.select("f", model.column(F.col("f")).alias("s")).limit(50).collect():
        assert r.s == pytest.approx(float(model.score(r.f)), abs=1e-12)
    assert 0.3 < model.prior < 0.99


def test_prior_is_the_share_of_positives():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.6, 0.9):
        good, bad = (np.histogram(np.clip(rng.normal(m, 0.12, n), 0, 1), 256, (0, 1))[0] for m, n in ((0.8, 40_000), (0.2, 40_000)))
        assert quality.prior_of(good, good * share + bad * (1 - share)) == pytest.approx(share, abs=0.04)


def test_nonnegative_risk_separates_without_negatives():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (4000, 2)), rng.normal(-1, 1, (1000, 2))
    unlabelled = np.vstack([good[2000:], bad])
    w = quality.fit_nonnegative(good[:2000], unlabelled, 2 / 3)
    z = lambda x: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert z(good).mean() > 0.8 and z(bad).mean() < 0.25


def test_quality_of_trouble(spark, labels):
    rows = [(None, None), (1, ""), (1, ""), (2, "x" * 3_000_000), (3, "a b\n" * 9)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, f int")
    got = quality.scored(docs, labels.limit(0)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.scored(docs.limit(0), labels).count() == 0
    wild = spark.createDataFrame([(1, None), (None, 1), (1, 1), (2, 0), (3, 1), (3, 1)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted(wild).filter("doc_id IS NOT NULL").collect()] in ([1, 3], [3, 1])
    assert len(quality.scored(docs, wild).collect()) == 5


def test_language_of_held_out_rows(docs):
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(truth) and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.97


def test_filters_contain_what_they_learned_and_little_else(docs):
    filters, letters = language_id.learn(docs), language_id._letters()
    f = np.array(filters.false_rate)
    assert (f < 0.05).all() and filters.names == ["de", "en", "es", "fr"]
    rng = np.random.default_rng(1)
    random = rng.integers(0, 1 << 63, 40_000, np.uint64)
    assert filters.counts(random) / len(random) == pytest.approx(f, abs=0.01)
    text = docs.filter("lang = 'de'").first().text
    hashes = language_id.gram_hashes(text, letters)
    plain = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    plain = "  " + re.sub(" +", " ", plain).strip() + "  "
    assert len(hashes) == len(plain) - 3
    assert len(np.unique(hashes)) == len({plain[i : i + 4] for i in range(len(plain) - 3)})
    assert filters.counts(hashes)[0] > 0.9 * len(hashes)


def test_language_of_trouble(spark, docs):
    rows = [(None, None, "en"), (1, "", "en"), (2, "12 !? _", None), (3, "日本語のテキスト", None), (4, "ß", "de"), (4, "ß", "de")]
    more = spark.createDataFrame([(i, t, x, 1) for i, t, x in rows], "doc_id long, text string, lang string, lang_pred int")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(more.unionByName(docs.limit(0).select("doc_id", "text", "lang", F.lit(1).alias("lang_pred")))).collect()}
    assert got[None] == got[1] == got[2] == "und" and got[3] in ("de", "en")
    blank = more.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(blank).collect()} == {"und"}
    assert language_id.identify(more.limit(0)).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/1?q#f", "https://a.b.example.net/en/",
    "http://example.net", "http://example.net?x=/en/", "http://badexample.net/en/", "http://net/a", "http://xnet/a", "ftp://example.com/de/x#y",
    "http://example.com/de", "http://m.x.org/fr/1", "http://x.org/fr", "http://x.org:80/fr/", "a://b://c.net/d", "http://É.NET/",
    "http://" + "x" * 9000 + ".org/" + "y" * 90_000, "http://casino-poker.example.com/", "http://museum-garden.example.com/",
]


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]
    best = None
    for r in url_filter.RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


def test_urls_follow_the_longest_rule(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h")], "page_id long, url string, host string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = plain_rule(URLS[r.page_id if r.page_id is not None else 5])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))
    by = {r.page_id: r for r in got}
    assert by[len(URLS) - 2].verdict == "block" and by[len(URLS) - 1].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "url string, label double")
    assert {r.verdict for r in url_filter.judge(pages, (), none).collect()} == {"allow"}


def test_url_model_is_logistic_regression_on_hashed_grams(spark):
    seeds = url_filter.seed_table(spark)
    h, p = url_filter.host_and_path(F.col("url"))
    rows = url_filter.featured(seeds.select(h.alias("host"), p.alias("path"), "label"))
    model = url_filter.train(rows)
    for r in model.transform(rows).limit(30).collect():
        z = float(r.features.dot(model.coefficients)) + model.intercept
        assert r.probability[1] == pytest.approx(1 / (1 + np.exp(-z)))
    hit = model.transform(rows).selectExpr("avg(CAST(label = prediction AS INT)) AS a").first().a
    assert hit > 0.97
