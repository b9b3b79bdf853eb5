"""Every query of the catalogue that SQL can express, against DuckDB."""

import math

import duckdb
import pytest

from probity.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def text(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query(spark, duck, name):
    got = QUERIES[name].run(spark, SMALL)
    cursor = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(names)
    rows = sorted([text(r[c]) for c in names] for r in got.collect())
    assert len(rows) == len(want)
    for a, b in zip(rows, sorted([text(x) for x in r] for r in want), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or abs(float(x) - float(y)) < 3e-5
