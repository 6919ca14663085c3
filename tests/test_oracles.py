"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    ours = sorted(([_plain(v) for v in r] for r in df.collect()), key=repr)
    theirs = sorted(([_plain(r[i]) for i in at] for r in cur.fetchall()), key=repr)
    assert ours == theirs
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and not n.startswith("op") and n != "pipeline"))
def test_runs_without_sql(spark, name):
    """Rows, each column with a value in some of them; what the values are is held against plain code in other modules."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
