"""The operators that SQL can express, against their SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from trackwell.llm import mixing, queries


def told(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    sql = con.execute(queries.oracle_sql()[name])
    assert told(df.columns, df.collect()) == told([d[0] for d in sql.description], sql.fetchall())


def test_mix_of_odd_rows_equals_sql(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, None if i % 5 == 0 else "w " * (i % 4)) for i in range(60)]
    rows += rows[:9] + [(None, "s1", "a b"), (None, None, None), (7, "only nulls", None)] + [(100 + i, "large", "many words " * 40) for i in range(30)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("h", F.lit("clash"))
    got = mixing.mixed(docs, entropy=None, repeats=2.0)[0].drop("text", "h")
    sql = con.execute(queries.oracle_sql()["op2_temperature_mix"])
    assert told(got.columns, got.collect()) == told([d[0] for d in sql.description], sql.fetchall())
