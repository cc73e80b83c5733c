"""Every engine query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from ledgerlark.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(value):
    return round(value, 6) if isinstance(value, float) and not math.isnan(value) else value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert columns
        return
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    assert rows == sorted((tuple(_norm(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "epic", "name"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
