import os

import duckdb
import pytest

import __spark_entry__ as entry
from letterloom.plans import queries as mail

SF = "/root/testdata/sf0.001"


def compared(spark, name, queries, sql, sf=SF):
    df = queries[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    rel = c.sql(sql[name])
    assert sorted(df.columns) == sorted(rel.columns)
    place = [rel.columns.index(n) for n in df.columns]
    want = [tuple(r[i] for i in place) for r in rel.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", list(mail.QUERIES))
def test_query_gives_what_sql_gives(spark, name):
    compared(spark, name, mail.QUERIES, mail.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(mail.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
