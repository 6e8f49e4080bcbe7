"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
from trackwell import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def told(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([told(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_sql(spark, small, views, name):
    df = registry.queries()[name](spark, small)
    sql = views.execute(registry.oracle_sql()[name])
    columns, wanted = [d[0] for d in sql.description], sql.fetchall()
    assert wanted, "the SQL gives no rows to compare"
    assert rows(df.columns, df.collect()) == rows(columns, wanted)


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns and df.count() > 0


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())
