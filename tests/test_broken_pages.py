"""What follows broken markup is read as well."""

import duckdb

from quillmere.catalog import ORACLES
from quillmere.functions.html import _flatten
from quillmere.operators import pages

REST = "<title>t {0}</title><h1>h {0}</h1><p>Licensed, version 2.{0}</p><a href='https://github.com/x{0}'>l</a>"
BREAKS = ["", "<![foo[x]]>", "<![ x>", "<![>", "<p>&#" + "9" * 4400 + ";</p>", "<a href='&#" + "9" * 5000 + "'>z</a>", "<![if IE]>", "<![CDATA[x]]>"]


def test_fields_behind_broken_markup(spark):
    rows = [(i, f"u{i}", x + REST.format(i)) for i, x in enumerate(BREAKS)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = pages.extract_page(df).collect()
    want = {(i, f"t {i}", f"h {i}", f"2.{i}", f"Licensed, version 2.{i}", f"https://github.com/x{i}") for i in range(len(BREAKS))}
    assert {(r.page_id, r.title, r.description, r.version, r.license, r.source_code_url) for r in out} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted((r.page_id, r.url, r.title) for r in out) == sorted(con.execute(ORACLES["extract_page"]).fetchall())


def test_long_numbers_are_read_by_value():
    page = _flatten("a&#" + "0" * 5000 + "65;&#00000000066;&#" + "7" * 4500 + ";b")
    assert page["prose"] == "aAB�b"
