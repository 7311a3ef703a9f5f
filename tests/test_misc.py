import datetime as dt

import pytest

from conftest import SF_SMALL
from martlet import schemas
from martlet.functions.dates import event_date, week_label
from martlet.operators import adhoc, profile
from martlet.session import scratch_path
from martlet.sinks import publish as sink
from martlet.sources import fixtures as fx
from martlet.sources.files import read_behavior_csv, read_items_csv, read_users_csv


def test_week_label_matches_python(spark):
    start = dt.date(1995, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(0, 11000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r.w for r in df.select(week_label("d").alias("w")).collect()]
    assert got == [d.strftime("%Y-%W") for d in days]


def test_event_date_zone(spark):
    df = spark.createDataFrame([(1704067199,)], "ts long")  # 2023-12-31 23:59:59 UTC
    r = df.select(event_date("ts").alias("u"), event_date("ts", "Asia/Shanghai").alias("s")).first()
    assert (str(r.u), str(r.s)) == ("2023-12-31", "2024-01-01")


@pytest.mark.parametrize("sql", [
    "```sql\nSELECT count(*) AS n FROM t;\n```",
    "WITH u AS (SELECT x FROM t) SELECT count(*) AS n FROM u",
    "SELECT count(*) AS n FROM t WHERE x IN (SELECT x FROM t)",
    "SELECT count(*) AS n FROM t WHERE 'delete; drop update' <> ''",
    "SELECT n FROM (SELECT count(*) AS n FROM t) s",
])
def test_adhoc_accepts_queries(spark, sql):
    df = spark.range(100).withColumnRenamed("id", "x")
    assert adhoc.describe_result(adhoc.run_adhoc(spark, sql, {"t": df})) == "n = 100"


@pytest.mark.parametrize("sql", [
    "", "DROP TABLE x", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2", "SELECT x FROM other",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM t",
    "SELECT x FROM t WHERE x < (SELECT length(try_reflect('java.lang.System', 'getProperty', 'user.home')))",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`",
    "SELECT x FROM t WHERE x IN (SELECT p_partkey FROM parquet.`/root/testdata/sf0.001/part.parquet`)",
    "SELECT * FROM range(10)", "SET spark.sql.ansi.enabled=false", "SHOW TABLES",
    "SELECT 1) AS a; DROP VIEW t; SELECT (1",
])
def test_adhoc_refuses(spark, sql):
    df = spark.range(3).withColumnRenamed("id", "x")
    with pytest.raises(ValueError):
        adhoc.run_adhoc(spark, sql, {"t": df})
    assert not spark.catalog.tableExists("t")


def test_adhoc_returns_every_row_and_leaves_no_view(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    out = adhoc.run_adhoc(spark, "SELECT x FROM t", {"t": df})
    assert out.count() == 100
    assert not spark.catalog.tableExists("t")
    assert adhoc.describe_result(adhoc.run_adhoc(spark, "SELECT x FROM t WHERE x < 0", {"t": df})) == "empty"
    assert adhoc.describe_result(out) == "rows"


def test_csv_sources_roundtrip(spark):
    root = scratch_path(spark, "csv")
    log = fx.behavior_log(spark, SF_SMALL)
    log.write.csv(f"{root}/log")
    fx.items(spark, SF_SMALL).write.option("header", True).csv(f"{root}/items")
    fx.users(spark, SF_SMALL).write.option("header", True).csv(f"{root}/users")
    back = read_behavior_csv(spark, f"{root}/log")
    assert back.schema == schemas.BEHAVIOR
    assert back.exceptAll(log).count() == 0 and log.exceptAll(back).count() == 0
    assert read_items_csv(spark, f"{root}/items").count() == spark.read.parquet(f"{SF_SMALL}/part.parquet").count()
    assert read_users_csv(spark, f"{root}/users").schema == schemas.USERS


def test_fixtures_keep_every_row(spark):
    n = lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet").count()
    assert fx.behavior_log(spark, SF_SMALL).count() == n("events")
    assert fx.items(spark, SF_SMALL).count() == n("part")
    assert fx.users(spark, SF_SMALL).count() == n("customer")
    assert fx.behavior_log(spark, SF_SMALL).select("item_id").distinct().count() > 50


def test_malformed_rows_are_counted(spark):
    from martlet.operators import clean
    rows = [(1, 2, 3, "pv", 10), (None, 2, 3, "pv", 10), (1, 2, 3, "buy", None), (1, 2, None, "pv", 11)]
    log = spark.createDataFrame(rows, schemas.BEHAVIOR)
    assert clean.malformed_events(log).count() == 2


def test_marts_of_one_commit_and_expiry(spark):
    root = scratch_path(spark, "commits")
    for n in (1, 2, 3):
        df = spark.range(n).selectExpr("CAST(id AS INT) AS user_id", "CAST(id AS STRING) AS rfm_label")
        sink.publish(spark, root, {"user_rfm": df, "other": df})
    assert sink.last_commit(spark, root) == 3
    marts = sink.read_marts(spark, root, ["user_rfm", "other", "missing"])
    assert set(marts) == {"user_rfm", "other"} and {df.count() for df in marts.values()} == {3}
    assert sink.expire(spark, root, keep=1) == 4
    assert sink.read_mart(spark, root, "other").count() == 3


def test_publish_switches_all_tables(spark):
    root = scratch_path(spark, "pub")
    v1 = spark.createDataFrame([(1, "a")], "user_id int, rfm_label string")
    sink.publish(spark, root, {"user_rfm": v1, "other": v1})
    assert sink.read_mart(spark, root, "user_rfm").count() == 1
    v2 = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, rfm_label string")
    sink.publish(spark, root, {"user_rfm": v2, "other": v2})
    assert sink.read_mart(spark, root, "user_rfm").count() == 2
    assert sink.read_mart(spark, root, "other").count() == 2
    with pytest.raises(KeyError):
        sink.read_mart(spark, root, "missing")


def test_pareto_share_exact(spark):
    # item counts 5,3,3,1,1 ... 10 items -> head = 2 items -> 5 + 3
    counts = {0: 5, 1: 3, 2: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    rows = [(1, i, 1, "pv", 0) for i, c in counts.items() for _ in range(c)]
    log = spark.createDataFrame(rows, schemas.BEHAVIOR)
    r = profile.pareto_share(log).first()
    assert (r.n_items, r.head_items, r.head_events, r.total_events) == (10, 2, 8, 18)


def test_hourly_volume_offset(spark):
    log = spark.createDataFrame([(1, 1, 1, "pv", 0), (1, 1, 1, "pv", 3600 * 17)], schemas.BEHAVIOR)
    h = {r.hour: r.events for r in profile.hourly_volume(spark, log).collect()}
    assert len(h) == 24 and h[8] == 1 and h[1] == 1 and sum(h.values()) == 2


def test_stage_conversion(spark):
    rows = [(1, 1, 1, t, 0) for t in ["pv"] * 6 + ["cart"] * 3 + ["buy"]]
    r = profile.stage_conversion(spark.createDataFrame(rows, schemas.BEHAVIOR)).first()
    assert (r.pv, r.cart, r.buy) == (10, 4, 1)
    assert (r.pv_to_cart_pct, r.cart_to_buy_pct, r.pv_to_buy_pct) == (40.0, 25.0, 10.0)


def test_clustered_layout_prunes_by_stats(spark):
    from martlet.operators import sales
    from martlet.sinks.publish import CLUSTERED_BY_DATE
    root = scratch_path(spark, "clustered")
    f = fx.sales_facts(spark, SF_SMALL)
    sink.publish(spark, root, {"buy_fact": f}, layouts={"buy_fact": CLUSTERED_BY_DATE})
    served = sink.read_mart(spark, root, "buy_fact")
    assert served.count() == f.count()
    a = sales.core_metrics(served, "1998-03-01", "1998-03-31").first()
    b = sales.core_metrics(f, "1998-03-01", "1998-03-31").first()
    assert a == b and a.total_sales == 3122127.04


def test_overwrite_fallback_and_segment_rows(spark):
    from martlet.operators.rfm import segment_rows
    root = scratch_path(spark, "ow")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, rfm_label string")
    assert sink.write_table(df, root, "user_rfm") == 2
    assert sink.write_table(df.limit(1), root, "user_rfm", mode="overwrite") == 1
    assert spark.read.parquet(root).count() == 1
    dist = spark.createDataFrame([("x", 3), ("y", 1)], "rfm_label string, cnt long")
    got = {r.name: (r.value, r.share_pct) for r in segment_rows(dist).collect()}
    assert got == {"x": (3, 75.0), "y": (1, 25.0)}


def test_dimension_csv_matched_by_name(spark):
    root = scratch_path(spark, "dimcsv")
    with open(f"{root}.csv", "w") as f:  # reordered columns, an extra one, a bad price
        f.write("price,extra,category_id,item_id\n9.90,x,3,1\nabc,y,4,2\n")
    items = read_items_csv(spark, f"{root}.csv").orderBy("item_id").collect()
    assert [(r.item_id, r.category_id, r.price) for r in items] == [
        (1, 3, __import__("decimal").Decimal("9.90")), (2, 4, None)]
    with open(f"{root}-u.csv", "w") as f:
        f.write("user_id,channel\n1,web\n")
    with pytest.raises(ValueError):
        read_users_csv(spark, f"{root}-u.csv")


def test_failed_stage_keeps_previous_version(spark):
    from pyspark.sql import functions as F
    root = scratch_path(spark, "pub-fail")
    good = spark.createDataFrame([(1, "a")], "user_id int, rfm_label string")
    sink.publish(spark, root, {"user_rfm": good, "other": good})
    broken = good.withColumn("rfm_label", F.when(F.col("user_id") > 0, F.raise_error(F.lit("boom"))).cast("string"))
    newer = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, rfm_label string")
    with pytest.raises(Exception):
        sink.publish(spark, root, {"user_rfm": newer, "other": broken})
    # neither table switched: readers still see the first, complete set
    assert sink.read_mart(spark, root, "user_rfm").count() == 1
    assert sink.read_mart(spark, root, "other").count() == 1
