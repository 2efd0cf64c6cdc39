"""Fingerprints of odd texts against the SQL of the query."""

import duckdb
import pytest

from quillmere.catalog import ORACLES, QUERIES

ODD = [
    None, "", " ", "\t\n \x0b", "\xa0", "　", "one", "one\xa0two three", "a　b c d", "x\x1cy\x1dz w", "m\x85n o", "p q r",
    "ΟΔΟΣ ΑΣ Σ", "İstanbul İ x", "AᲉB ꟋC \U00010d50Σ D", "ẞ Ǆ K Å é É", "a\x0bb\x0cc\rd", "tie one",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = ODD + [" ".join(f"a{c}b{c}" for c in points[i : i + 100]) for i in range(0, len(points), 100)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5), (6, "TWO", "en", "s", 3), (6, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    df.repartition(8).write.parquet(f"{base}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{base}/documents.parquet/*.parquet'")
    return str(base), con


def test_odd_texts_have_the_fingerprints_of_the_sql(spark, odd):
    base, con = odd
    got = {tuple(r) for r in QUERIES["simhash"](spark, base).collect()}
    want = set(con.execute(ORACLES["simhash"]).fetchall())
    assert got == want
    assert {r[0] for r in want}.isdisjoint(range(4)) and None in {r[0] for r in want}


def test_near_copies_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    texts = [t for t in ODD if t] + ["one", "one two", "one\xa0two", "ΟΔΟΣ ΑΣ Σ", "οδοσ ασ σ", "  "]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in QUERIES["near_dups"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(con.execute(ORACLES["near_dups"]).fetchall(), key=repr)
