"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def own():
    return sorted(q for q in entry.queries() if not q.startswith("op") and q != "pipeline")


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", own())
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        a = sorted(tuple(canon(r[c]) for c in cols) for r in rows)
        b = sorted(tuple(canon(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
        assert a == b
