"""The corpus queries that SQL can express give the rows of their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from palimpsest.llm import queries

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def test_queries_and_their_sql_are_registered():
    assert all(callable(__spark_entry__.queries()[name]) for name in queries.QUERIES)
    assert all(isinstance(sql, str) and __spark_entry__.oracle_sql()[name] == sql for name, sql in queries.ORACLE_SQL.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(DIR):
        con.sql(f"create view {table[:-8]} as select * from '{DIR}/{table}'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
