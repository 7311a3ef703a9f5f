"""End-to-end batch pipeline on the smallest tables."""

import json

import pytest
from pyspark.sql import Observation

from conftest import SF_SMALL
from martlet import oracle
from martlet.operators import clean, cohort, facts, funnel, rfm
from martlet.plans.etl import build_marts, run_etl
from martlet.session import scratch_path
from martlet.sinks import publish as sink
from martlet.sources import fixtures as fx


def expected(duck):
    """Row counts and null counters of the fixtures, from the DuckDB twins."""
    sql = oracle.oracle_sql()
    raw, kept, _ = duck.execute(sql["dq_drop_rate"]).fetchone()
    price, channel, age = duck.execute(sql["dq_nulls"]).fetchone()
    buys = len(duck.execute(sql["buy_fact"]).fetchall())
    return raw, price, channel, age, kept, buys


def test_run_etl_publishes_consistent_marts(spark, duck):
    raw, price, channel, age, kept, buys = expected(duck)
    root = scratch_path(spark, "etl")
    log, items, users = fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL)
    out = run_etl(spark, log, items, users, root, window=fx.LOG_WINDOW, model_path=f"{root}/model")
    assert (out["raw_rows"], out["missing_price"], out["missing_channel"], out["missing_age_group"],
            out["clean_rows"]) == (raw, price, channel, age, kept)
    assert out["buy_fact_rows"] == buys and out["rejected_events_rows"] == price
    cl = clean.load_and_clean(log, items, users, fx.LOG_WINDOW)
    # published marts equal the lazily defined ones
    for name, df in [("buy_fact", facts.buy_fact(cl.wide)),
                     ("cohort_matrix", cohort.cohort_matrix(cl.wide)),
                     ("user_funnel_mart", funnel.build_funnels(cl.wide)[0])]:
        got = sink.read_mart(spark, root, name).select(*df.columns)
        assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0, name
        assert out[f"{name}_rows"] == df.count()
    rfm_rows = sink.read_mart(spark, root, "user_rfm")
    assert rfm_rows.count() == out["user_rfm_rows"] == cl.wide.filter("type = 'buy'").select("user_id").distinct().count()
    log_row = spark.read.parquet(f"{root}/etl_dq_log").collect()
    assert len(log_row) == 1
    logged = json.loads(log_row[0].metrics)
    assert logged["raw_rows"] == raw and logged["cutoff_date"] == out["cutoff_date"]
    assert logged["drop_rate_pct"] == round((1 - kept / raw) * 100, 2)
    assert len(json.loads(log_row[0].cluster_profiles)) == out["kmeans_best_k"]
    from pyspark.ml.clustering import KMeansModel
    assert len(KMeansModel.load(f"{root}/model").clusterCenters()) == out["kmeans_best_k"]
    # the dashboard entry points over the published marts
    from martlet.plans.dashboard import Dashboard
    dash = Dashboard.from_published(spark, root)
    s, e = dash.facts.select(*dash.resolve()).first()
    assert (e - s).days == 30
    totals = funnel.funnel_totals(funnel.build_funnels(cl.wide)[0], s, e).first()
    assert [r.value for r in dash.funnel().collect()] == [totals.pv, totals.cart, totals.buy]
    assert dash.core().first().paying_users == totals.buy
    buyers = facts.buy_fact(cl.wide).filter(f"date BETWEEN '{s}' AND '{e}'").select("user_id").distinct().count()
    assert sum(r.value for r in dash.rfm().collect()) == buyers
    assert set(dash.all(period="month")) >= {"core", "trend", "funnel", "rankings", "dimensions", "retention", "rfm"}


def test_window_reaches_the_scan(spark):
    import contextlib
    import io
    root = scratch_path(spark, "pushed")
    fx.behavior_log(spark, SF_SMALL).write.parquet(root)
    marts = build_marts(spark.read.parquet(root), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL),
                        fx.LOG_WINDOW, segment=False, observation=Observation("o"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        marts.joined.explain("formatted")
    marts.release()
    assert "GreaterThanOrEqual(ts," in out.getvalue() and "LessThan(ts," in out.getvalue()


def test_failed_fit_publishes_nothing_and_cleans_up(spark, monkeypatch):
    root = scratch_path(spark, "etl-fail")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(rfm, "segment_users", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run_etl(spark, fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL),
                root, window=fx.LOG_WINDOW)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert sink.last_commit(spark, root) == 0
    assert not sink.exists(spark, f"{root}/buy_fact/") or not spark._jvm.java.io.File(f"{root}/buy_fact").list()


def test_run_etl_table_materialisation_matches(spark, duck):
    root = scratch_path(spark, "etl-table")
    log, items, users = fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL)
    out = run_etl(spark, log, items, users, root, window=fx.LOG_WINDOW, materialize="table")
    raw, price, _, _, kept, buys = expected(duck)
    assert (out["raw_rows"], out["missing_price"], out["clean_rows"], out["buy_fact_rows"]) == (raw, price, kept, buys)
    cl = clean.load_and_clean(log, items, users, fx.LOG_WINDOW)
    got = sink.read_mart(spark, root, "user_funnel_loose_mart")
    want = funnel.build_funnels(cl.wide)[1]
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_command_line_on_csv_inputs(spark, duck):
    from martlet.__main__ import main
    root = scratch_path(spark, "cli")
    fx.behavior_log(spark, SF_SMALL).write.csv(f"{root}/log")
    fx.items(spark, SF_SMALL).write.option("header", True).csv(f"{root}/items")
    fx.users(spark, SF_SMALL).write.option("header", True).csv(f"{root}/users")
    out = main(["--behavior", f"{root}/log", "--items", f"{root}/items", "--users", f"{root}/users",
                "--out", f"{root}/marts", "--start", "2024-01-01", "--end", "2024-01-31"], spark=spark)
    raw, _, _, _, kept, buys = expected(duck)
    assert (out["raw_rows"], out["clean_rows"], out["buy_fact_rows"]) == (raw, kept, buys)
    assert sink.read_mart(spark, f"{root}/marts", "buy_fact").count() == buys


def test_command_line_parquet_inputs_and_argument_check(spark, duck):
    from martlet.__main__ import main
    root = scratch_path(spark, "cli-pq")
    fx.behavior_log(spark, SF_SMALL).write.parquet(f"{root}/log")
    fx.items(spark, SF_SMALL).write.parquet(f"{root}/items")
    fx.users(spark, SF_SMALL).write.parquet(f"{root}/users")
    args = ["--behavior", f"{root}/log", "--items", f"{root}/items", "--users", f"{root}/users",
            "--out", f"{root}/marts", "--format", "parquet"]
    with pytest.raises(SystemExit):
        main(args + ["--start", "2024-01-01"], spark=spark)
    out = main(args + ["--start", "2024-01-01", "--end", "2024-01-31", "--materialize", "persist"], spark=spark)
    raw, _, _, _, kept, buys = expected(duck)
    assert (out["raw_rows"], out["clean_rows"], out["buy_fact_rows"]) == (raw, kept, buys)
