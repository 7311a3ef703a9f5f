import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martlet import schemas  # noqa: E402
from martlet.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8)
    yield s
    s.stop()


def D(s):
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the smallest tables, for expected values."""
    import duckdb
    from martlet.sources.fixtures import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.fixture()
def buy_fact(spark):
    """Four orders of a spring: one with two lines, one a month later."""
    rows = [
        (D("2021-05-03"), 7, "A1", 501, 31, Decimal("12.50"), "web", "18-24"),
        (D("2021-05-03"), 8, "A2", 502, 32, Decimal("40.00"), "app", "25-34"),
        (D("2021-05-03"), 8, "A2", 503, 32, Decimal("7.25"), "app", "25-34"),
        (D("2021-05-10"), 9, "A3", 502, 32, Decimal("40.00"), "store", "46+"),
        (D("2021-06-01"), 7, "A4", 504, 33, Decimal("100.00"), "web", "18-24"),
    ]
    return spark.createDataFrame(rows, schemas.BUY_FACT)


@pytest.fixture()
def funnel_mart(spark):
    """Four user-days: one buyer on two of them."""
    rows = [(1, D("2021-05-03"), 1, 1, 0), (2, D("2021-05-03"), 1, 1, 1),
            (3, D("2021-05-04"), 1, 0, 0), (2, D("2021-05-05"), 1, 1, 1)]
    return spark.createDataFrame(rows, schemas.FUNNEL_MART)


@pytest.fixture()
def cohort_rows(spark):
    return spark.createDataFrame(
        [(D("2021-05-03"), 0, 50, 50), (D("2021-05-03"), 1, 20, 50), (D("2021-05-03"), 3, 13, 50)],
        schemas.COHORT_MATRIX)


def ts(s: str) -> int:
    """'YYYY-MM-DD HH:MM:SS' (UTC) -> epoch seconds."""
    return int(dt.datetime.fromisoformat(s).replace(tzinfo=dt.timezone.utc).timestamp())
