"""The cube and mergeable sets against the facts."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from conftest import SF_SMALL, D
from martlet import registry, schemas
from martlet.operators import cube, sales
from martlet.plans import dashboard
from martlet.session import scratch_path
from martlet.sinks import publish as sink
from martlet.sources import fixtures as fx


@pytest.fixture(scope="module")
def facts(spark):
    """Orders with several lines, orders over several days, rows without an
    order, one day with most rows."""
    rng = random.Random(5)
    day = lambda: D("2021-05-03") + dt.timedelta(days=rng.choice([0, 0, 0, 0, rng.randrange(500)]))
    rows = [(day(), rng.randrange(40), rng.choice([None, *(f"o{rng.randrange(300)}" for _ in range(9))]), rng.randrange(30),
             rng.randrange(6), Decimal(rng.randrange(1, 9999)) / 100, rng.choice("abc"), rng.choice("xy")) for _ in range(900)]
    return spark.createDataFrame(rows, schemas.BUY_FACT)


def test_numbers_are_dense_and_follow_first_dates(facts):
    got = cube.dense_numbers(facts, "order_id", after=7).collect()
    first = {r.order_id: r.d for r in facts.where("order_id IS NOT NULL").groupBy("order_id").agg({"date": "min"})
             .toDF("order_id", "d").collect()}
    assert sorted(r.number for r in got) == list(range(8, 8 + len(first)))
    assert [r.order_id for r in sorted(got, key=lambda r: r.number)] == sorted(first, key=lambda o: (first[o], o))


def test_numbers_over_buckets(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("DATE'2021-01-01' AS date", "CAST(id AS STRING) AS order_id", "CAST(1 AS DECIMAL(10,2)) AS price")
    sets = cube.member_sets(rows, cube.dense_numbers(rows, "order_id"), "order_id")
    assert sets.count() == -(-n // 32768)
    assert tuple(cube.set_core(sets, "2021-01-01", "2021-01-01").first()) == (float(n), n)


@pytest.mark.parametrize("period", ["day", "week", "month"])
def test_sets_merge_into_any_period(spark, facts, period):
    sets = cube.member_sets(facts, cube.dense_numbers(facts, "order_id"), "order_id")
    for a, b in (("2021-05-03", "2022-12-31"), ("2021-06-10", "2021-09-02"), ("1990-01-01", "1990-02-01")):
        assert cube.set_trend(sets, a, b, period).collect() == sales.trend(facts, a, b, period).collect()
        assert cube.set_core(sets, a, b).collect() == sales.core_metrics(facts, a, b).collect()
        assert cube.set_growth(sets, a, b, period).collect() == sales.growth(facts, a, b, period).collect()


def test_sets_by_attribute(spark, facts):
    sets = cube.member_sets(facts, cube.dense_numbers(facts, "user_id"), "user_id", "channel")
    got = {r.channel: r.cnt for r in cube.set_distribution(sets, "2021-05-03", "2021-12-31", "channel").collect()}
    want = {r[0]: r[1] for r in sales.in_range(facts, "2021-05-03", "2021-12-31").groupBy("channel")
            .agg({"user_id": "approx_count_distinct"}).collect()}
    exact = {r.channel: len(set(u)) for r, u in
             ((r, r.u) for r in sales.in_range(facts, "2021-05-03", "2021-12-31").groupBy("channel")
              .agg({"user_id": "collect_set"}).toDF("channel", "u").collect())}
    assert got == exact and set(got) == set(want)


def test_slices_equal_the_separate_queries(facts):
    a, b = "2021-05-03", "2021-10-31"
    got = sorted(map(tuple, cube.ranked_slices(cube.sales_cells(facts), a, b, 4).collect()))
    want = [("rankings", r.item_label, r.sales) for r in sales.top_items(facts, a, b, 4).collect()]
    want += [(r.dimension, r.name, r.sales) for r in sales.dimension_breakdown(facts, a, b, 4).collect()]
    assert got == sorted(want)


def test_empty_facts(spark):
    facts = spark.createDataFrame([], schemas.BUY_FACT)
    sets = cube.member_sets(facts, cube.dense_numbers(facts, "order_id"), "order_id")
    assert tuple(cube.set_core(sets, "2021-01-01", "2021-01-02").first()) == (0.0, 0)
    assert cube.set_trend(sets, "2021-01-01", "2021-01-02").count() == 0
    assert cube.ranked_slices(cube.sales_cells(facts), "2021-01-01", "2021-01-02").count() == 0


def test_bundle_reads_the_cube_once_and_no_facts(spark):
    root = registry._published(spark, SF_SMALL, cubes=True)
    dash = dashboard.Dashboard.from_published(spark, root)
    got = dash.bundle("2024-01-01", "2024-01-30", "week")
    want = dashboard.bundle_long(dash.all("2024-01-01", "2024-01-30", "week"))
    key = lambda r: (r.section, r.name)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    files = [f for f in got.inputFiles()]
    assert not any("/buy_fact/" in f for f in files) and any("/sales_cells/" in f for f in files)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("/sales_cells") <= 1
    scans = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "item_id#" in x and "Relation" in x]
    assert len(scans) == 1


def test_bundle_without_cubes_reads_the_facts(spark):
    root = registry._published(spark, SF_SMALL)
    dash = dashboard.Dashboard.from_published(spark, root)
    assert not dash.cubes and {r.section for r in dash.bundle("2024-01-01", "2024-01-30").collect()} >= {"core", "rankings"}


def test_sales_cells_are_additive(spark):
    rows = fx.sales_facts(spark, SF_SMALL)
    cells = cube.sales_cells(rows)
    assert cells.agg({"sales": "sum", "n_rows": "sum"}).first().asDict() == {
        "sum(sales)": rows.agg({"price": "sum"}).first()[0], "sum(n_rows)": rows.count()}
    root = scratch_path(spark, "cells")
    sink.publish(spark, root, {"sales_cells": cells})
    back = sink.read_mart(spark, root, "sales_cells")
    assert back.schema == schemas.SALES_CELLS and back.exceptAll(cells).count() == 0
