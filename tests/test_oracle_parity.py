"""Every registered query against its DuckDB oracle on the smallest tables.

Same check as the driver's gate: column names, row count and the
order-insensitive multiset of values (doubles exact after the queries' own
documented rounding).
"""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from relscope.plans import catalog
from relscope.plans.fixtures import BASE_TABLES

KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows, scols = [tuple(r) for r in df.collect()], list(df.columns)
    rel = con.sql(E.oracle_sql()[key])
    orows, ocols = rel.fetchall(), list(rel.columns)
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _rows(scols, srows) == _rows(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "macro_f1" in df.columns
