"""Every registered query against its DuckDB twin on the smallest tables."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from martlet import oracle, registry
from martlet.registry import ROWS_ONLY
from martlet.sources.fixtures import TABLES


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_key_has_a_twin_or_is_rows_only():
    assert set(registry.queries()) == set(oracle.oracle_sql()) | set(ROWS_ONLY)
    assert set(registry.queries()) <= set(E.queries()) and set(oracle.oracle_sql()) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert _canon(df.columns, rows) == _canon(cols, cur.fetchall())


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 10 and "item_label" in df.columns
