import json

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from martlet.constants import (LABEL_CHURNED, LABEL_CORE_VALUE, LABEL_LOYAL,
                               LABEL_POTENTIAL, LABEL_REGULAR, LABEL_UNMAPPED)
from martlet.operators import clean, quality, rfm
from martlet.sources import fixtures as fx

LABELS = {LABEL_CHURNED, LABEL_CORE_VALUE, LABEL_LOYAL, LABEL_POTENTIAL, LABEL_REGULAR, LABEL_UNMAPPED}


@pytest.fixture(scope="module")
def cleaned(spark):
    return clean.load_and_clean(fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL),
                                fx.users(spark, SF_SMALL), fx.LOG_WINDOW)


def test_fixture_exercises_every_counter(cleaned):
    n = quality.dq_nulls(cleaned.joined).first()
    assert 0 < n.missing_channel < n.missing_age_group and n.missing_price > 0
    assert cleaned.wide.count() == cleaned.joined.count() - n.missing_price
    assert cleaned.priced.count() == cleaned.wide.count()


def test_fit_leaves_no_cache_and_raises(spark, cleaned, monkeypatch):
    from pyspark.ml.clustering import KMeans
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    base = rfm.rfm_base(cleaned.priced, rfm.cutoff_value(cleaned.events))
    rfm.segment_users(base)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    monkeypatch.setattr(KMeans, "fit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("executor lost")))
    with pytest.raises(RuntimeError):
        rfm.segment_users(base)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_nearest_given_centre(spark):
    zs = spark.createDataFrame([(1, 0, 1, 2.0, -1.0, 1.0, 1.0), (2, 9, 1, 4.0, 1.0, 0.0, 0.0), (3, 9, 1, 6.0, 0.0, 0.0, 0.0)],
                               "user_id int, R int, F long, M double, R_z double, F_z double, M_z double")
    got = rfm.assign_centers(zs, [(-1, 1, 1), (1, 0, 0)])
    # buyer 3 is nearer to the second centre
    assert {r.user_id: r.cluster for r in got.collect()} == {1: 0, 2: 1, 3: 1}
    rows = rfm.profile_clusters(got, {0: "x", 1: "y"}).collect()
    assert [(r.label, r.m_mean, r.user_count) for r in rows] == [("y", 5.0, 2), ("x", 2.0, 1)]


def test_segments(spark, cleaned):
    base = rfm.rfm_base(cleaned.wide, rfm.cutoff_value(cleaned.events))
    seg = rfm.segment_users(base)
    users = seg.user_rfm.collect()
    assert len(users) == base.count()
    assert {r.rfm_label for r in users} <= LABELS
    assert [k for k, _ in seg.sweep] == [3, 4, 5]
    assert seg.best_k == max(seg.sweep, key=lambda t: (t[1], -t[0]))[0]
    prof = rfm.cluster_profiles(seg).collect()
    assert sum(r.user_count for r in prof) == len(users)
    assert [r.user_count for r in prof] == sorted((r.user_count for r in prof), reverse=True)
    sweep = rfm.sweep_frame(spark, seg).collect()
    assert sum(r.chosen for r in sweep) == 1


def test_zscores_standardised(cleaned):
    base = rfm.rfm_base(cleaned.wide, rfm.cutoff_value(cleaned.events))
    z = rfm.rfm_zscores(base, digits=None).agg(F.avg("R_z").alias("m"), F.stddev_samp("R_z").alias("s")).first()
    assert abs(z.m) < 1e-9 and z.s == pytest.approx(1.0)


def test_zero_variance_is_zero(spark):
    base = spark.createDataFrame([(1, 2, 1, 5.0), (2, 2, 1, 5.0)], "user_id int, R int, F long, M double")
    assert {r.R_z for r in rfm.rfm_zscores(base).collect()} == {0.0}


def test_warnings_and_log(spark, cleaned):
    w = quality.dq_warnings(quality.dq_nulls(cleaned.joined)).collect()
    assert [r.metric for r in w] == ["missing_price", "missing_channel", "missing_age_group"]
    assert w[0].message.startswith(f"{w[0].n} rows")
    metrics = quality.dq_metrics(cleaned.raw, fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL), fx.LOG_WINDOW)
    m = {r.metric: r.value for r in metrics.collect()}
    raw, kept = cleaned.raw.count(), cleaned.wide.count()
    assert m["raw_rows"] == raw and m["clean_rows"] == kept and m["malformed_rows"] == 0
    assert m["drop_rate_pct"] == round((1 - kept / raw) * 100, 2)
    row = quality.dq_log_row(metrics, quality.dq_warnings(quality.dq_nulls(cleaned.joined)), None,
                             __import__("datetime").datetime(2024, 1, 1), 1.5).first()
    assert json.loads(row.metrics)["raw_rows"] == raw
    assert len(json.loads(row.warnings)) == 3 and json.loads(row.cluster_profiles) == []


def test_metrics_count_as_the_joins_do(spark):
    """Duplicate, missing and NULL keys, rows outside the window: the counters
    of one pass equal those of the joined table."""
    import random
    from decimal import Decimal
    from martlet import schemas
    from martlet.operators import clean, facts
    rng = random.Random(3)
    day = 86400
    log = spark.createDataFrame(
        [(rng.choice([1, 2, 3, 9, None]), rng.choice([1, 2, 3, 9, None]), 1, rng.choice(["pv", "buy", None]),
          rng.choice([None, *range(0, 10 * day, day // 2)])) for _ in range(400)], schemas.BEHAVIOR)
    items = spark.createDataFrame([(1, 1, Decimal(5)), (1, 1, None), (2, 1, None), (3, 1, Decimal(1)), (3, 1, Decimal(2)),
                                   (None, 1, None)], schemas.ITEMS)
    users = spark.createDataFrame([(1, "a", "c"), (1, None, "c"), (2, "a", None), (None, None, None)], schemas.USERS)
    window = ("1970-01-02", "1970-01-05")
    cl = clean.load_and_clean(log, items, users, window)
    got = {r.metric: r.value for r in quality.dq_metrics(log, items, users, window, marts=True).collect()}
    nulls = quality.dq_nulls(cl.joined).first().asDict()
    raw, kept = log.count(), cl.wide.count()
    assert got == {
        "raw_rows": raw, "malformed_rows": clean.malformed_events(log).count(), "clean_rows": kept, **nulls,
        "drop_rate_pct": round((1 - kept / raw) * 100, 2), "item_rows": 6, "unpriced_items": 3, "duplicate_item_keys": 2,
        "user_rows": 4, "users_without_channel": 2, "users_without_age_group": 2, "duplicate_user_keys": 1,
        "buy_fact_rows": facts.buy_fact(cl.wide).count()}


def test_metrics_of_an_empty_log(spark):
    from martlet import schemas
    empty = [spark.createDataFrame([], s) for s in (schemas.BEHAVIOR, schemas.ITEMS, schemas.USERS)]
    got = {r.metric: r.value for r in quality.dq_metrics(*empty, marts=True).collect()}
    assert got.pop("drop_rate_pct") == 100.0 and set(got.values()) == {0.0}


def test_metrics_read_each_input_once(spark):
    df = quality.dq_metrics(fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL),
                            fx.LOG_WINDOW, marts=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    for table, times in (("events", 1), ("customer", 1), ("part", 1)):
        # the item number of the fixture comes from a scalar over part, a plan of its own
        assert sum(f"/{table}.parquet" in line and "p_size" not in line for line in scans) <= times + (table == "part"), scans


def test_fused_takes_one_pass_per_source(spark):
    a, b = spark.range(10), spark.range(4)
    df = quality.fused([quality.Metric("n", a, F.count("*")), quality.Metric("m", b, F.count("*")),
                        quality.Metric("top", spark.range(10), F.max("id"))])
    assert {r.metric: r.value for r in df.collect()} == {"n": 10, "m": 4, "top": 9}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2


def test_no_warnings_when_clean(spark):
    nulls = spark.createDataFrame([(0, 0, 0)], "missing_price long, missing_channel long, missing_age_group long")
    assert quality.dq_warnings(nulls).count() == 0


def test_duplicate_dimension_keys(spark):
    dim = spark.createDataFrame([(1,), (1,), (2,)], "item_id int")
    assert [r.item_id for r in quality.duplicate_keys(dim, "item_id").collect()] == [1]


@pytest.mark.parametrize("rows", [
    [(1, 3, 1, 10.0)],                                   # one buyer
    [(1, 3, 1, 10.0), (2, 0, 4, 99.0)],                  # fewer buyers than k
    [(i, 2, 1, 5.0) for i in range(6)],                  # identical buyers
])
def test_segments_degenerate_inputs(spark, rows):
    base = spark.createDataFrame(rows, "user_id int, R int, F long, M double")
    seg = rfm.segment_users(base)
    out = seg.user_rfm.collect()
    assert len(out) == len(rows) and {r.rfm_label for r in out} <= LABELS
    assert [k for k, _ in seg.sweep] == [3, 4, 5]


def test_segments_reproducible_across_layouts(spark, cleaned):
    base = rfm.rfm_base(cleaned.wide, rfm.cutoff_value(cleaned.events))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts, spread in ((8, 1), (3, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            seg = rfm.segment_users(base.repartition(spread))
            labels = {r.user_id: r.rfm_label for r in seg.user_rfm.collect()}
            results.append((seg.best_k, [round(s, 9) for _, s in seg.sweep], labels))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
