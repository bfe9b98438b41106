"""Registered queries against the SQL registered with them, on the smallest tables."""

import decimal
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    frame = query(spark, str(DATA))
    told = con.execute(sql)
    names = [x[0] for x in told.description]
    assert sorted(frame.columns) == sorted(names)
    got = [tuple(plain(r[c]) for c in names) for r in frame.collect()]
    want = [tuple(plain(v) for v in r) for r in told.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
