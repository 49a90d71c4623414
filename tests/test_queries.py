"""Every registered query with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from molloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def shaped(rows, columns):
    def text(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.REGISTERED[name](spark, SF)
    want = duck.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert shaped(df.collect(), df.columns) == shaped(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
