"""Every query with a SQL twin gives the same values; the others give rows."""

import pytest
from oracle import connect, difference, duck_side, spark_side

from quillmere.catalog import ORACLES, QUERIES

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(spark_side(QUERIES[name](spark, BASE)), duck_side(duck, ORACLES[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, BASE).count() > 0
