"""One user holding 40% of all events: results stay exact, and the
aggregation plans shuffle partial aggregates, never raw rows, on user keys."""

import contextlib
import io
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from martlet.session import scratch_path
from martlet.sources.fixtures import TABLES

HOT_USER = 7
CHECKED = ["wide_events", "first_touch", "funnel_strict", "funnel_loose", "cohort_matrix",
           "rfm_base", "rfm_zscores", "buy_fact", "funnel_totals", "dq_nulls", "pareto_share"]


@pytest.fixture(scope="module")
def skewed_dir(spark):
    root = scratch_path(spark, "skew")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    hot = F.when(F.col("event_id") % 5 < 2, F.lit(HOT_USER).cast("long")).otherwise(F.col("user_id"))
    ev.withColumn("user_id", hot).coalesce(1).write.parquet(f"{root}/events.parquet")
    for t in TABLES:
        if t != "events":
            spark.read.parquet(f"{SF_SMALL}/{t}.parquet").coalesce(1).write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.fixture(scope="module")
def con(skewed_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet/*.parquet')")
    return c


def test_hot_user_share(con):
    share = con.execute(f"SELECT avg(CASE WHEN user_id = {HOT_USER} THEN 1.0 ELSE 0 END) FROM events").fetchone()[0]
    assert share >= 0.4


@pytest.mark.parametrize("name", CHECKED)
def test_exact_under_skew(spark, con, skewed_dir, name):
    df = E.queries()[name](spark, skewed_dir)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]

    def canon(c, rows):
        order = sorted(range(len(c)), key=lambda i: c[i])
        return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else
                             (str(r[i]) if r[i] is not None else None) for i in order) for r in rows), key=repr)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(cols, cur.fetchall())


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", ["first_touch", "funnel_strict", "cohort_matrix", "rfm_base"])
def test_user_keyed_exchanges_carry_partial_aggregates(spark, skewed_dir, name):
    lines = _plan(E.queries()[name](spark, skewed_dir)).splitlines()
    seen = 0
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(" in line and "user_id" in line:
            seen += 1
            child = lines[i + 1]
            assert re.search(r"HashAggregate|ObjectHashAggregate|Window|Sort", child), (name, line, child)
            # a Sort child must itself sit over an aggregate (window input)
            if "Sort" in child:
                assert "HashAggregate" in lines[i + 2], (name, lines[i + 2])
    assert seen >= 1, name


def test_shuffle_join_splits_hot_user(spark, skewed_dir):
    """With the user dimension over the broadcast threshold, the events ⟕ users
    join shuffles; AQE splits the hot user's partition (skew join). RFM, built
    without that join, still shuffles only partial aggregates by user."""
    from martlet.operators import clean
    from martlet.sources import fixtures as fx
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        log = fx.behavior_log(spark, skewed_dir)
        items, users = fx.items(spark, skewed_dir), fx.users(spark, skewed_dir)
        forced = clean.load_and_clean(log, items, users, fx.LOG_WINDOW).joined
        rows = forced.collect()
        assert "SortMergeJoin(skew=true)" in _plan(forced)
        lines = _plan(E.queries()["rfm_base"](spark, skewed_dir)).splitlines()
        by_user = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(user_id" in x]
        assert by_user and all("HashAggregate" in lines[i + 1] for i in by_user)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    broadcast = clean.load_and_clean(log, items, users, fx.LOG_WINDOW).joined
    cols = broadcast.columns
    key = lambda r: tuple(str(r[c]) for c in cols)
    assert sorted(map(key, rows)) == sorted(map(key, broadcast.collect()))


def test_hot_date_is_split_when_publishing(spark):
    """Most purchases on one date: the rebalanced write spreads that date
    over several tasks (files) instead of one."""
    import datetime as dt
    import os
    from martlet.sinks.publish import write_table
    rows = spark.range(20000).select(
        F.when(F.col("id") % 10 == 0, F.lit(dt.date(2024, 1, 2))).otherwise(F.lit(dt.date(2024, 1, 1))).alias("date"),
        (F.col("id") % 997).cast("int").alias("user_id"),
        F.col("id").cast("string").alias("order_id"),
        F.lit(1).alias("item_id"), F.lit(1).alias("category_id"),
        F.lit(1.5).cast("decimal(10,2)").alias("price"), F.lit("c").alias("channel"), F.lit("a").alias("age_group"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        path = scratch_path(spark, "hotdate")
        assert write_table(rows.repartition(8), path, "buy_fact") == 20000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot = [f for f in os.listdir(f"{path}/date=2024-01-01") if f.endswith(".parquet")]
    assert len(hot) > 1
    assert spark.read.parquet(path).count() == 20000
