"""Streaming ingest: exactly-once across restarts from the checkpoint."""

from conftest import SF_SMALL
from martlet.operators import clean, facts
from martlet.session import scratch_path
from martlet.sources import fixtures as fx
from martlet.streaming import ingest


def test_restart_resumes_without_duplicates(spark):
    root = scratch_path(spark, "stream-restart")
    log, items, users = fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL), fx.users(spark, SF_SMALL)
    early = log.filter("ts < 1705000000")
    late = log.filter("ts >= 1705000000")

    def run():
        stream = ingest.read_log_stream(spark, f"{root}/in", max_files_per_trigger=1)
        out = ingest.buy_fact_stream(stream, items, users, fx.LOG_WINDOW)
        ingest.start_parquet_sink(out, f"{root}/out", f"{root}/ckpt").awaitTermination()
        return spark.read.parquet(f"{root}/out")

    ingest.stage_files(early, f"{root}/in", n_files=3)
    first = run().count()
    assert run().count() == first                      # restart, no new files: nothing added
    ingest.stage_files(late, f"{root}/in", n_files=2)
    got = run()
    want = facts.buy_fact(clean.load_and_clean(log, items, users, fx.LOG_WINDOW).wide)
    assert got.count() == want.count() > 0
    assert got.select(*want.columns).exceptAll(want).count() == 0


def test_daily_volume_stream_complete_table(spark):
    root = scratch_path(spark, "stream-daily")
    log, items = fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL)
    ingest.stage_files(log, f"{root}/in", n_files=3)
    stream = ingest.read_log_stream(spark, f"{root}/in", max_files_per_trigger=1)
    ingest.start_table_sink(ingest.daily_volume_stream(stream, items), f"{root}/daily",
                            f"{root}/ckpt").awaitTermination()
    daily = ingest.read_table_sink(spark, f"{root}/daily")
    assert daily.groupBy().sum("events").first()[0] == log.count()
