"""Rows that do not parse: kept with line and reason, out of every mart."""

import json

from conftest import SF_SMALL
from martlet import schemas
from martlet.operators import dead_letters
from martlet.plans.etl import run_etl
from martlet.session import scratch_path
from martlet.sinks import publish as sink
from martlet.sources import files
from martlet.sources import fixtures as fx

LINES = {
    "1,2,3,pv,10": None, '1,2,3,"pv",10': None, " 1 , 2,3, pv ,10": None, "1,2,,pv,10": None, "-5,+6,7,pv,-1": None,
    "1,2,3,pv": "fields", "1,2,3,pv,10,9": "fields", '1,2,3,"pv,10': "fields", "x": "fields",
    "abc,2,3,pv,10": "user_id", "1.5,2,3,pv,10": "user_id", "99999999999,2,3,pv,10": "user_id",
    "1,,3,pv,10": "item_id", "1,2,x,pv,10": "category_id", "1,2,3,,10": "type", "1,2,3,pv,noon": "ts",
    "1,2,3,pv,99999999999999999999": "ts", "1,z,3,pv,": "item_id,ts", ",,,,": "user_id,item_id,type,ts",
}


def test_every_line_is_a_row_or_a_dead_letter(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in [*LINES, "", "   "]], "value string").write.text(path)
    parsed = files.read_behavior_lines(spark, path)
    assert {r.line: r.reason for r in parsed.collect()} == LINES
    rows, bad = dead_letters.clean_rows(parsed), dead_letters.rejected_lines(parsed)
    assert rows.count() + bad.count() == len(LINES) and rows.schema == schemas.BEHAVIOR
    assert (-5, 6, 7, "pv", -1) in [tuple(r) for r in rows.collect()]
    assert {r.line: r.reason for r in bad.collect()} == {k: v for k, v in LINES.items() if v}


def test_typed_rows_are_set_aside(spark):
    rows = [(1, 2, 3, "pv", 10), (None, 2, 3, "pv", 10), (1, 2, None, "pv", 11), (1, None, 3, None, None)]
    log = spark.createDataFrame(rows, schemas.BEHAVIOR)
    assert sorted(map(tuple, dead_letters.set_aside(log).collect())) == [(",2,3,pv,10", "user_id"), ("1,,3,,", "item_id,type,ts")]
    assert dead_letters.well_formed(log).count() == 2


def _run(spark, log, root):
    return run_etl(spark, log, fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL), root, window=fx.LOG_WINDOW)


def test_pipeline_over_broken_lines(spark):
    root = scratch_path(spark, "broken")
    fx.raw_lines(spark, SF_SMALL).write.text(f"{root}/log")
    parsed = files.read_behavior_lines(spark, f"{root}/log")
    out = _run(spark, parsed, f"{root}/marts")
    n, bad = fx.table(spark, SF_SMALL, "events").count(), dead_letters.rejected_lines(parsed)
    assert out["raw_rows"] == n and out["malformed_rows"] == bad.count() > 0
    kept = sink.read_mart(spark, f"{root}/marts", "dead_letters")
    assert kept.exceptAll(bad).count() == 0 and kept.count() == bad.count()
    marts = sink.read_mart(spark, f"{root}/marts", "buy_fact")
    assert marts.where("user_id IS NULL OR item_id IS NULL").count() == 0
    logged = json.loads(spark.read.parquet(f"{root}/marts/etl_dq_log").first().metrics)
    assert (logged["raw_rows"], logged["malformed_rows"]) == (n, out["malformed_rows"])


def test_pipeline_over_a_typed_log_with_holes(spark):
    root = scratch_path(spark, "holes")
    log = fx.behavior_log(spark, SF_SMALL).selectExpr(
        "IF(ts % 10 = 0, NULL, user_id) AS user_id", "item_id", "category_id", "type", "ts")
    out = _run(spark, log, root)
    holes = log.where("user_id IS NULL").count()
    assert out["malformed_rows"] == holes == sink.read_mart(spark, root, "dead_letters").count() > 0
    assert sink.read_mart(spark, root, "rejected_events").where("user_id IS NULL").count() == 0
    assert out["clean_rows"] + out["missing_price"] + holes == out["raw_rows"]


def test_pipeline_without_dead_letters_has_an_empty_table(spark):
    root = scratch_path(spark, "none")
    fx.behavior_log(spark, SF_SMALL).write.csv(f"{root}/log")
    out = _run(spark, files.read_behavior_lines(spark, f"{root}/log"), f"{root}/marts")
    kept = sink.read_mart(spark, f"{root}/marts", "dead_letters")
    assert out["malformed_rows"] == 0 and kept.count() == 0 and kept.schema == schemas.DEAD_LETTERS
