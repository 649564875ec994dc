"""Every query of the library against its SQL in DuckDB, and the contract of the entry module."""

from __future__ import annotations

import duckdb
import pytest

from helioframe.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(x):
    cols = sorted(x.columns)
    show = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return x[cols].map(show).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    mine, theirs = same(QUERIES[name](spark, SF).toPandas()), same(duck.sql(ORACLE_SQL[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.equals(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_range_reaches_the_scan(spark):
    plan = QUERIES["q04_date_range_half_open"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "props" not in plan.split("ReadSchema")[1]
