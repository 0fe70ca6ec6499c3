"""Every query with SQL gives the same rows in both engines on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sql, name):
    got = entry.queries()[name](spark, BASE)
    cols = sorted(got.columns)
    cur = sql.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in cur.description]
    assert sorted(heads) == cols
    want = [tuple(plain(r[heads.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
