"""Every registered query against its SQL in DuckDB, on the smallest given tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from taskledger.plans import all_checks, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = all_queries(), all_checks()
ROWS_ONLY: set[str] = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def as_text(value: object) -> str:
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def test_every_query_has_a_check():
    assert set(QUERIES) - set(CHECKS) == ROWS_ONLY
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(as_text(r[c]) for c in columns) for r in df.collect())
    if name in ROWS_ONLY:
        assert got
        return
    found = db.execute(CHECKS[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(tuple(as_text(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
