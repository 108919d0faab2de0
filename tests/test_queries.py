"""Every registered query with oracle SQL against DuckDB on the given tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pkgscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(rows):
    def cell(x):
        return "null" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_oracle(spark, sf, oracle, name):
    got = registry.QUERIES[name](spark, sf)
    want = oracle.execute(registry.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert tidy(got.select(*columns).collect()) == tidy([[r[i] for i in at] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
