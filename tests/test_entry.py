"""Registered queries against their SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith(("op", "pipeline"))}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in df.collect())
    assert got == want


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    order = {"BLOCK": 0, "REVIEW": 1, "ALLOW": 2}
    assert rows and [(order[r.band], -r.score) for r in rows] == sorted((order[r.band], -r.score) for r in rows)
