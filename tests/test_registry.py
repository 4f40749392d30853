"""Every registered query against its SQL on the smallest tables; schema and rows must agree."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registry
from tools.check import TABLES, digest

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows) == digest(names, expected)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert df.count() == 6000 and "finished" in df.columns
