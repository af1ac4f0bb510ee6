"""Every query that SQL can express gives the rows of its SQL."""

import os

import duckdb
import pytest

from palimpsest.plans import blueprint, exports, operations

DIR = "/root/testdata/sf0.001"
ORACLES = {**blueprint.ORACLES, **operations.ORACLES, **exports.ORACLES}
QUERIES = {**blueprint.QUERIES, **operations.QUERIES, **exports.QUERIES}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"create view {name[:-8]} as select * from '{DIR}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), sql.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if str(got[c].dtype).startswith("datetime"):
            got[c], want[c] = got[c].astype(str), want[c].astype(str)
    assert rows(got) == rows(want)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
