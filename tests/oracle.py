"""Run registered queries against their SQL twins in DuckDB and compare values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillmere.sources.io import TABLES  # noqa: E402

SF = "/root/testdata/sf0.01"


def connect(base: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = tuple(columns[i] for i in order)
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def spark_side(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_side(con, sql):
    cur = con.execute(sql)
    return table([d[0] for d in cur.description], cur.fetchall())


def difference(got, want) -> str | None:
    """None when equal, else what differs."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}; {got[1][:2]} vs {want[1][:2]}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None


def main(names: list[str]) -> int:
    from quillmere.catalog import ORACLES, QUERIES
    from quillmere.runtime import build_session

    spark, con, bad = build_session(), connect(), 0
    picked = [n for n in QUERIES if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for name in picked:
        start = time.time()
        try:
            got = spark_side(QUERIES[name](spark, SF))
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS {name} {len(got[1])} {took:.1f}s {str(got[1][:1])[:200]}")
                continue
            start = time.time()
            diff = difference(got, duck_side(con, ORACLES[name]))
            sql_took = time.time() - start
        except Exception as e:  # noqa: BLE001 - report and go on
            diff, took, sql_took = f"{type(e).__name__}: {str(e)[:700]}", time.time() - start, 0
        if diff:
            bad += 1
        print(f"{'FAIL' if diff else 'ok  '} {name} {len(got[1]) if not diff else ''} {took:.1f}s sql {sql_took:.1f}s {(diff or '')[:900]}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
