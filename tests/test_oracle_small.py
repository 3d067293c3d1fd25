"""Every registered query against its DuckDB twin on the sf0.001 tables
(order-insensitive, exact values); rows-only queries must run."""

import datetime as dt
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL_SF
from tools.check_oracle import TABLES, rows_key

from ledgerlens.plans import catalog

ORACLE = E.oracle_sql()
QUERIES = {k: v for k, v in E.queries().items() if k in catalog.QUERIES}      # the optional ones have tests of their own


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL_SF):
        pytest.skip("driver tables not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_listed():
    rows_only = {"topk_docs_lsh"}
    assert set(QUERIES) - set(ORACLE) == rows_only


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL_SF)
    srows = df.collect()
    if name not in ORACLE:
        assert df.columns
        return
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    # money leaves the registry as doubles, dates as text, on both sides
    # (the edge_types map is complete)
    assert not any(isinstance(v, (Decimal, dt.date)) and not isinstance(v, dt.datetime) for r in drows for v in r)
    assert not any(isinstance(v, (Decimal, dt.date)) and not isinstance(v, dt.datetime) for r in srows for v in r)
    assert rows_key(df.columns, srows) == rows_key(dcols, drows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "variance_percent" in df.columns
