"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is planned from the raw tables and executed in full with the
no-op sink (every row is produced, nothing is collected). One warm-up run
loads classes; each query is then timed ``BENCH_REPEAT`` (default 5) times and the median
is reported. The full batch pipeline (clean -> marts -> KMeans -> publish ->
DQ log) is timed once as ``etl_pipeline``. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_items", "trend_day", "funnel_strict", "cohort_matrix", "user_rfm"]
EXTRA = ["core_metrics", "growth_month", "dimension_breakdown", "kpi_summary",
         "dashboard_bundle", "rfm_base", "pareto_share", "wide_events"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "5"))
    from martlet.session import build_session, scratch_path
    from martlet.plans.etl import run_etl
    from martlet.sources import fixtures as fx
    from martlet.registry import queries

    spark = build_session(master=f"local[{cpus}]", app="martlet-bench",
                          shuffle_partitions=int(cpus))
    qs = queries()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("core_metrics")  # warm-up
    timings = {}
    for name in HEADLINE + EXTRA:
        timings[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)

    t0 = time.perf_counter()
    summary_root = scratch_path(spark, "bench-marts")
    summary = run_etl(spark, fx.behavior_log(spark, sf_dir), fx.items(spark, sf_dir),
                      fx.users(spark, sf_dir), summary_root,
                      window=fx.LOG_WINDOW, tz=fx.LOG_TZ)
    etl = time.perf_counter() - t0
    timings["etl_pipeline"] = round(etl, 3)

    # Serve path: dashboard queries over published, date-partitioned marts
    # (what the dashboard reads after the pipeline has run).
    from martlet.sinks.publish import CLUSTERED_BY_DATE, publish, read_mart
    from martlet.operators import sales
    from martlet.plans.dashboard import Dashboard
    root = scratch_path(spark, "bench-serve")
    t0 = time.perf_counter()
    publish(spark, root, {"buy_fact": fx.sales_facts(spark, sf_dir)},
            layouts={"buy_fact": CLUSTERED_BY_DATE})
    timings["publish_sales_facts"] = round(time.perf_counter() - t0, 3)
    served = read_mart(spark, root, "buy_fact")
    span, month = fx.SALES_SPAN, fx.SALES_MONTH
    serve = {
        "serve_core_metrics": lambda: sales.core_metrics(served, *month),
        "serve_trend_day": lambda: sales.trend(served, *span, "day"),
        "serve_top_items": lambda: sales.top_items(served, *span),
        "serve_growth_month": lambda: sales.growth(served, *month, "month"),
        "serve_dimension_breakdown": lambda: sales.dimension_breakdown(served, *month),
    }
    for name, mk in serve.items():
        def once():
            t = time.perf_counter()
            mk().write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t
        once()
        timings[name] = round(statistics.median(once() for _ in range(repeat)), 3)
    marts_root = summary_root
    t0 = time.perf_counter()
    bundle = Dashboard.from_published(spark, marts_root).bundle(fx.LOG_WINDOW[0], "2024-01-30", "week")
    bundle.write.format("noop").mode("overwrite").save()
    timings["serve_dashboard_bundle"] = round(time.perf_counter() - t0, 3)

    value = round(sum(timings[n] for n in HEADLINE), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total_seconds", "value": value, "unit": "sec",
        "queries": timings, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus), "repeat": repeat, "headline": HEADLINE,
        "etl_rows_per_sec": round(summary["raw_rows"] / etl, 1),
        "etl_raw_rows": summary["raw_rows"],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
