"""Incremental funnel state, bucketed marts and run-time date ranges."""

import random

import pytest

from martlet import schemas
from martlet.operators import funnel, funnel_state, rfm
from martlet.session import scratch_path
from martlet.sinks import commits
from martlet.sinks import publish as sink

DAY = 86400


@pytest.fixture(scope="module")
def wide(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, *range(2, 25)]), rng.randrange(6), rng.choice(["pv", "pv", "cart", "buy"]),
             rng.randrange(12 * DAY)) for _ in range(1500)]
    return spark.createDataFrame(rows, "user_id int, item_id int, type string, ts long").cache()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


COLUMNS = ["user_id", "date", "has_pv", "has_cart", "has_buy"]


@pytest.mark.parametrize("kind", ["strict", "loose"])
def test_any_order_of_batches_gives_the_batch_funnel(spark, wide, kind):
    state = funnel_state.FunnelState(spark, scratch_path(spark, "state"), kind)
    want = funnel.build_funnels(wide)[kind == "loose"].select(*COLUMNS)
    days = [7, 0, 3, 11, 1, 2, 4, 10, 9, 8, 5, 6]
    for at in range(0, 12, 3):                       # late days in every batch
        batch = wide.where(f"floor(ts / {DAY}) IN ({','.join(map(str, days[at:at + 3]))})")
        assert state.update(batch, f"b{at}")
    assert same(state.mart().select(*COLUMNS), want)
    assert same(state.touches(), funnel.first_touch(wide).select("user_id", "item_id", "first_pv", "first_cart", "first_buy"))
    # a batch is applied once, compaction changes nothing, updates go on after it
    assert not state.update(wide, "b3") and len(state.segments()) == 4
    assert state.compact() and len(state.segments()) == 1 and not state.update(wide, "b0")
    assert same(state.mart().select(*COLUMNS), want)
    more = spark.createDataFrame([(99, 1, "pv", 5), (1, 5, "pv", 0)], wide.schema)
    assert state.update(more, "late")
    assert same(state.mart().select(*COLUMNS), funnel.build_funnels(wide.union(more))[kind == "loose"].select(*COLUMNS))


def test_only_touched_users_are_rebuilt(spark, wide):
    state = funnel_state.FunnelState(spark, scratch_path(spark, "touched"))
    state.update(wide, "first")
    state.update(wide.where("user_id IN (3, 4)").limit(5), "second")
    rows = spark.read.schema(schemas.FUNNEL_MART).parquet(f"{state.segments()[1]['path']}/rows")
    assert {r.user_id for r in rows.select("user_id").distinct().collect()} <= {3, 4}
    assert same(state.mart().select(*COLUMNS), funnel.build_funnels(wide)[0].select(*COLUMNS))


def test_an_empty_batch_and_an_empty_state(spark, wide):
    state = funnel_state.FunnelState(spark, scratch_path(spark, "empty-state"))
    assert state.mart().count() == 0 and state.touches().count() == 0
    assert state.update(wide.limit(0), "none") and state.mart().count() == 0
    with pytest.raises(ValueError):
        funnel_state.FunnelState(spark, "x", "other")


def test_a_writer_in_between_is_built_upon(spark, wide, monkeypatch):
    """Another batch is committed while one is staged: it is staged again."""
    root = scratch_path(spark, "between")
    one, two = funnel_state.FunnelState(spark, root), funnel_state.FunnelState(spark, root)
    create, calls = commits.create, []

    def interrupted(*args):
        calls.append(args)
        if len(calls) == 1:
            assert two.update(wide.where("ts % 2 = 1"), "odd")
        return create(*args)
    monkeypatch.setattr(commits, "create", interrupted)
    assert one.update(wide.where("ts % 2 = 0"), "even")
    assert [s["batches"] for s in one.segments()] == [["odd"], ["even"]]
    assert same(one.mart().select(*COLUMNS), funnel.build_funnels(wide)[0].select(*COLUMNS))


def test_bucketed_marts_join_without_an_exchange(spark):
    rng = random.Random(9)
    facts = spark.createDataFrame([(rng.choice([1, 1, rng.randrange(200)]), f"2021-01-{1 + rng.randrange(28):02d}") for _ in range(3000)],
                                  "user_id int, date string").selectExpr("user_id", "CAST(date AS DATE) AS date")
    segments = spark.createDataFrame([(u, "abc"[u % 3]) for u in range(150)], schemas.USER_RFM)
    days = sink.write_bucketed(rfm.buyer_days(facts), scratch_path(spark, "days"), "user_id", 5)
    path = scratch_path(spark, "segments")
    sink.write_bucketed(segments, path, "user_id", 5)
    again = sink.read_bucketed(spark, path, schemas.USER_RFM, "user_id", 5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = rfm.rfm_distribution(days, again, "2021-01-05", "2021-01-20")
        got = {r.rfm_label: r.cnt for r in df.collect()}
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("Exchange" in line for line in lines[join:]) and any("Exchange" in line for line in lines[:join])
    want = rfm.rfm_distribution(facts, segments, "2021-01-05", "2021-01-20")
    assert got == {r.rfm_label: r.cnt for r in want.collect()}


def _jobs(spark):
    """Jobs of the current group."""
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("range-test"))


def test_default_range_runs_nothing_and_prunes_at_run_time(spark):
    import datetime as dt
    from decimal import Decimal

    from martlet.functions.dates import comparison_windows
    from martlet.operators import sales
    rng = random.Random(4)
    rows = [(dt.date(2021, 1, 1) + dt.timedelta(days=rng.randrange(90)), rng.randrange(9), f"o{n}", 1, 1, Decimal(n), "a", "b")
            for n in range(400)]
    path = scratch_path(spark, "folders")
    sink.write_table(spark.createDataFrame(rows, schemas.BUY_FACT), path, "buy_fact")
    facts = spark.read.schema(schemas.BUY_FACT).parquet(path)
    last = max(r[0] for r in rows)
    spark.sparkContext.setJobGroup("range-test", "definition")
    bounds = sales.default_bounds(facts)
    made = [sales.trend(facts, *bounds), sales.top_items(facts, *bounds), sales.core_metrics(facts, *bounds),
            *[sales.growth(facts, *bounds, p) for p in ("day", "week", "month")]]
    assert _jobs(spark) == 0
    spark.sparkContext.setJobGroup("other", "run")
    first = last - dt.timedelta(days=30)
    fixed = [sales.trend(facts, first, last), sales.top_items(facts, first, last), sales.core_metrics(facts, first, last),
             *[sales.growth(facts, first, last, p) for p in ("day", "week", "month")]]
    for a, b in zip(made, fixed):
        assert a.collect() == b.collect()
    scan = [x for x in made[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x]
    assert any("ubquery" in x.split("PartitionFilters")[1] for x in scan)
    # windows moved by Columns equal those moved on the driver, month ends too
    for s, e in (("2021-03-31", "2021-03-31"), ("2024-02-29", "2024-03-30"), ("2021-01-01", "2021-12-31")):
        for period in ("day", "week", "month"):
            want = comparison_windows(s, e, period)
            from pyspark.sql import functions as F
            got = comparison_windows(F.lit(s).cast("date"), F.lit(e).cast("date"), period)
            row = spark.range(1).select(*[c for k in want for c in got[k]]).first()
            assert list(row) == [d for k in want for d in want[k]]
