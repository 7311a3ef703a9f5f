"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs one operator (or one composed plan) over the whole supplied
tables, mapped onto the shop model by ``martlet.sources.fixtures``. The DuckDB
twins live in ``martlet.oracle``; queries without a twin (KMeans-based, run
log) get the driver's rows-only check.

Row-level money leaves a registered query as DOUBLE ("at the edge"): every
DECIMAL(10,2) value converts to the same nearest double in Spark and DuckDB,
so results compare equal however they are fetched. Operators and published
marts keep DECIMAL(10,2), and sums are taken on the decimals.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.casts import safe_double, safe_int
from .functions.segments import segment_label_py
from .operators import (adhoc, clean, clustering, cohort, cube, dead_letters, facts, funnel, funnel_state,
                        profile, quality, rfm, sales)
from .plans import dashboard
from .schemas import BUY_FACT
from .session import scratch_path
from .sinks import publish as sink
from .sources import fixtures as fx
from .sources import files
from .streaming import ingest as streaming

LOG_START, LOG_END = fx.LOG_WINDOW[0], "2024-01-30"
SPAN_START, SPAN_END = fx.SALES_SPAN
MONTH_START, MONTH_END = fx.SALES_MONTH
PREV_MONTH = ("1998-02-01", "1998-02-28")
DRILL_DAY = "2024-01-15"
KPI_RANGE = ("2024-01-16", "2024-01-30")   # has a previous window inside the log
LAST_COHORTS = 3
CENTERS = ((-0.6, 0.7, 0.6), (0.9, -0.5, -0.5), (0.0, 0.0, 0.0))
BATCHES, TREND_DAYS = 4, 9
LLOYD_STEPS, FIXPOINT_TOLERANCE = 4, 1e-3
LOG_RUNS = (_dt.datetime(2024, 2, 1), _dt.datetime(2024, 2, 2))
ADHOC_STATEMENT = ("SELECT channel, CAST(SUM(price) AS DOUBLE) AS sales, "
                   "COUNT(DISTINCT order_id) AS orders FROM buy_fact GROUP BY channel")


# ---- shared inputs -------------------------------------------------------

def _edge(df: DataFrame) -> DataFrame:
    """Row-level ``price`` as DOUBLE for the registered output."""
    return df.withColumn("price", F.col("price").cast("double")) if "price" in df.columns else df


def _log(spark, d):
    return fx.behavior_log(spark, d)


def _cleaned(spark, d) -> clean.Cleaned:
    return clean.load_and_clean(_log(spark, d), fx.items(spark, d), fx.users(spark, d),
                                fx.LOG_WINDOW, fx.LOG_TZ)


def _wide(spark, d):
    return _cleaned(spark, d).wide


def _sales(spark, d, *columns):
    return fx.sales_facts(spark, d, *columns)


# What the sales queries need of the facts.
_DAILY = ("date", "order_id", "price")


def _strict(spark, d):
    return funnel.build_funnels(_wide(spark, d), fx.LOG_TZ)[0]


def _loose(spark, d):
    return funnel.build_funnels(_wide(spark, d), fx.LOG_TZ)[1]


def _rfm_base(spark, d):
    cl = _cleaned(spark, d)
    return rfm.rfm_base(cl.priced, rfm.cutoff_value(cl.events))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rule_segments(base: DataFrame) -> DataFrame:
    """Segment table by the label rule on each buyer's z-scores."""
    return rfm.segment_rule(rfm.rfm_zscores(base, digits=None)).withColumnRenamed("rule_label", "rfm_label")


def _published(spark, d, cubes: bool = False) -> str:
    """Root of marts published from one written pass over the log."""
    cl = _cleaned(spark, d)
    wide = _written(cl.wide, "wide")
    strict, loose = funnel.build_funnels(wide, fx.LOG_TZ)
    root = scratch_path(spark, "marts")
    marts = {
        "buy_fact": facts.buy_fact(wide), "user_funnel_mart": strict, "user_funnel_loose_mart": loose,
        "cohort_matrix": cohort.cohort_matrix(wide),
        "user_rfm": _rule_segments(rfm.rfm_base(wide, rfm.cutoff_value(cl.events)))}
    if cubes:
        marts["user_rfm"] = _written(marts["user_rfm"], "segments")
        marts |= dashboard.cube_marts(marts["buy_fact"], marts["user_rfm"])
    sink.publish(spark, root, marts)
    return root


def _segments(spark, d) -> rfm.Segments:
    return rfm.segment_users(_rfm_base(spark, d))


def _bundle(spark, d, start, end, period):
    return dashboard.Dashboard.from_published(spark, _published(spark, d, cubes=True)).bundle(start, end, period)


def _order_sets(spark, d):
    """Daily order sets of the sales facts, written once as a mart is."""
    rows = _sales(spark, d, *_DAILY)
    return _written(cube.member_sets(rows, cube.dense_numbers(rows, "order_id"), "order_id"), "day-orders")


def _buyer_sets(spark, d):
    rows = facts.buy_fact(_written(_wide(spark, d), "wide"))
    marts = dashboard.cube_marts(rows, _rule_segments(_rfm_base(spark, d)))
    return _written(marts["day_buyers"], "day-buyers")


# ---- queries -------------------------------------------------------------

def _q_dq_counts(spark, d):
    cl = _cleaned(spark, d)
    wide = _written(cl.wide, "wide")
    strict, loose = funnel.build_funnels(wide, fx.LOG_TZ)
    return quality.dq_counts({
        "raw_log": cl.raw, "items": fx.items(spark, d), "users": fx.users(spark, d),
        "clean": wide, "buy_fact": (wide, facts.is_purchase()),
        "user_rfm": rfm.rfm_base(wide, rfm.cutoff_value(cl.events)),
        "cohort_matrix": cohort.cohort_matrix(wide),
        "user_funnel_mart": strict, "user_funnel_loose_mart": loose,
    })


def _metrics(spark, d, marts: bool = True):
    return quality.dq_metrics(_log(spark, d), fx.items(spark, d), fx.users(spark, d), fx.LOG_WINDOW, fx.LOG_TZ, marts)


def _q_kmeans_sweep(spark, d):
    return rfm.sweep_frame(spark, _segments(spark, d))


def _q_cluster_profiles(spark, d):
    return rfm.cluster_profiles(_segments(spark, d))


def _q_rfm_distribution(spark, d):
    seg = _segments(spark, d)
    return rfm.rfm_distribution(facts.buy_fact(_wide(spark, d)), seg.user_rfm, LOG_START, LOG_END)


def _q_safe_cast(spark, d):
    ev = fx.table(spark, d, "events")
    k_text = F.regexp_extract("props", r'"k":\s*([^}]*)\}', 1)
    return ev.select(
        "event_id",
        safe_int(k_text).alias("k_int"),
        safe_double(k_text).alias("k_double"),
        safe_double("event_type").alias("type_double"),
        safe_int("value", numeric=True).alias("value_int"),
        safe_int(F.col("value").cast("string")).alias("value_text_int"),
        safe_double(F.col("value").cast("string"), None).alias("value_text_double"),
    )


def _q_kpi_summary(spark, d):
    """Facts and strict funnel from one written pass over the log."""
    wide = _written(_wide(spark, d), "wide")
    return sales.kpi_summary(facts.buy_fact(wide), funnel.build_funnels(wide, fx.LOG_TZ)[0], *KPI_RANGE, "day")


def _q_trend_default(spark, d):
    """The trend of the default range over facts in date folders."""
    path = scratch_path(spark, "buy-fact")
    sink.write_table(facts.buy_fact(_wide(spark, d)), path, "buy_fact")
    stored = spark.read.schema(BUY_FACT).parquet(path)
    return sales.trend(stored, *sales.default_bounds(stored, TREND_DAYS), "day")


def _q_adhoc(spark, d):
    return adhoc.run_adhoc(spark, ADHOC_STATEMENT, {"buy_fact": _sales(spark, d)})


def _q_read_back(name):
    return lambda spark, d: _edge(sink.read_mart(spark, _published(spark, d), name))


def _q_csv(name):
    """A table written as CSV and read with the CSV reader of its kind."""
    make, header, read = {
        "behavior": (_log, False, files.read_behavior_csv),
        "items": (fx.items, True, files.read_items_csv),
        "users": (fx.users, True, files.read_users_csv)}[name]

    def query(spark, d):
        path = scratch_path(spark, f"csv-{name}")
        make(spark, d).write.option("header", header).csv(path)
        return _edge(read(spark, path))
    return query


def _parsed_lines(spark, d):
    """The log with broken lines, written as text and read line by line."""
    path = scratch_path(spark, "raw-lines")
    fx.raw_lines(spark, d).write.text(path)
    return files.read_behavior_lines(spark, path)


def _q_line_counts(spark, d):
    """Lines per reason ('' for rows): all lines are in exactly one part."""
    return (_parsed_lines(spark, d).groupBy(F.coalesce("reason", F.lit("")).alias("reason"))
            .agg(F.count("*").alias("lines")))


def _bucketed(spark, d):
    """Buyer days and rule segments, both in buckets by user."""
    wide = _written(_wide(spark, d), "wide")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    segments = _rule_segments(_rfm_base(spark, d))
    return [sink.write_bucketed(df, scratch_path(spark, "bucketed"), "user_id", buckets)
            for df in (rfm.buyer_days(facts.buy_fact(wide)), segments.select("user_id", "rfm_label"))]


def _incremental(kind):
    """The funnel after the log came in batches, every fourth day in each."""
    def query(spark, d):
        wide = _written(_wide(spark, d), "wide")
        state = funnel_state.FunnelState(spark, scratch_path(spark, f"funnel-{kind}"), kind, fx.LOG_TZ)
        for n in range(BATCHES):
            state.update(wide.where(F.dayofyear("date") % BATCHES == n), f"batch-{n}")
        return state.mart().select("user_id", "date", "has_pv", "has_cart", "has_buy")
    return query


def _q_rule_distribution(spark, d):
    return rfm.rfm_distribution(facts.buy_fact(_wide(spark, d)), _rule_segments(_rfm_base(spark, d)),
                                LOG_START, LOG_END)


def _q_center_profiles(spark, d):
    zs = rfm.rfm_zscores(_rfm_base(spark, d), digits=None)
    return rfm.profile_clusters(rfm.assign_centers(zs, CENTERS),
                                {i: segment_label_py(c) for i, c in enumerate(CENTERS)})


def _assigned(spark, d):
    """Buyers' z-scores, each with the nearest of the fixed centres."""
    return rfm.assign_centers(_written(rfm.rfm_zscores(_rfm_base(spark, d), digits=None), "zscores"), CENTERS)


def _q_lloyd(spark, d):
    zs = _written(rfm.rfm_zscores(_rfm_base(spark, d), digits=None), "zscores")
    return clustering.lloyd(zs, CENTERS, LLOYD_STEPS).select(
        "cluster_id", "user_count", *[F.round(a, 6).alias(a) for a in clustering.AXES])


def _q_kmeans_fixpoint(spark, d):
    """The fitted segmentation, written, checked as data."""
    seg = rfm.segment_users(_written(_rfm_base(spark, d), "rfm-base"))
    points = _written(clustering.z_points(seg.clustered), "assignment")
    return clustering.fixpoint(points, seg.centers, seg.labels, FIXPOINT_TOLERANCE)


def _q_dq_log_append(spark, d):
    """Two runs appended to the DQ log, read back and unpacked."""
    cl = _cleaned(spark, d)
    metrics = _written(_metrics(spark, d), "dq")
    warnings = _written(quality.dq_warnings(quality.dq_nulls(cl.joined)), "dq-warnings")
    path = scratch_path(spark, "dq-log")
    for run in LOG_RUNS:
        sink.append_log(quality.dq_log_row(metrics, warnings, None, run, 0.0), path)
    back = spark.read.parquet(path)
    return back.select(F.date_format("run_time", "yyyy-MM-dd").alias("run_day"),
                       F.size(F.from_json("warnings", "array<string>")).alias("n_warnings"),
                       F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value"))


def _stream_input(spark, d):
    root = scratch_path(spark, "stream")
    streaming.stage_files(_log(spark, d), f"{root}/in", n_files=4)
    return root, streaming.read_log_stream(spark, f"{root}/in", max_files_per_trigger=2)


def _q_stream_buy_fact(spark, d):
    root, stream = _stream_input(spark, d)
    out = streaming.buy_fact_stream(stream, fx.items(spark, d), fx.users(spark, d), fx.LOG_WINDOW, fx.LOG_TZ)
    streaming.start_parquet_sink(out, f"{root}/out", f"{root}/ckpt").awaitTermination()
    return _edge(spark.read.parquet(f"{root}/out"))


def _q_stream_daily_volume(spark, d):
    root, stream = _stream_input(spark, d)
    out = streaming.daily_volume_stream(stream, fx.items(spark, d))
    streaming.start_table_sink(out, f"{root}/daily", f"{root}/ckpt").awaitTermination()
    return streaming.read_table_sink(spark, f"{root}/daily")


def _q_dq_log(spark, d):
    cl = _cleaned(spark, d)
    seg = rfm.segment_users(rfm.rfm_base(cl.priced, rfm.cutoff_value(cl.events)))
    return quality.dq_log_row(_metrics(spark, d, marts=False), quality.dq_warnings(quality.dq_nulls(cl.joined)),
                              rfm.cluster_profiles(seg), _dt.datetime(2024, 2, 1), 0.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query: name -> callable(spark, sf_dir) -> DataFrame."""
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # sources
        "scan_behavior": lambda s, d: _log(s, d),
        "scan_items": lambda s, d: _edge(fx.items(s, d)),
        "scan_users": lambda s, d: fx.users(s, d),
        "scan_behavior_csv": _q_csv("behavior"),
        "scan_items_csv": _q_csv("items"),
        "scan_users_csv": _q_csv("users"),
        "csv_clean_rows": lambda s, d: dead_letters.clean_rows(_parsed_lines(s, d)),
        "csv_dead_letters": lambda s, d: dead_letters.rejected_lines(_parsed_lines(s, d)),
        "csv_line_counts": _q_line_counts,
        # cleaning
        "clean_events": lambda s, d: clean.derive_events(_log(s, d), fx.LOG_WINDOW, fx.LOG_TZ),
        "wide_events": lambda s, d: _edge(_wide(s, d)),
        "rejected_events": lambda s, d: _edge(clean.rejected_events(_cleaned(s, d).joined)),
        "buy_fact": lambda s, d: _edge(facts.buy_fact(_wide(s, d))),
        # data quality
        "data_cutoff": lambda s, d: quality.data_cutoff(_cleaned(s, d).events),
        "dq_counts": _q_dq_counts,
        "dq_nulls": lambda s, d: quality.dq_nulls(_cleaned(s, d).joined),
        "dq_drop_rate": lambda s, d: quality.dq_drop_rate(_log(s, d), _wide(s, d)),
        "dq_metrics": _metrics,
        "dq_warnings": lambda s, d: quality.dq_warnings(quality.dq_nulls(_cleaned(s, d).joined)),
        # funnels
        "first_touch": lambda s, d: funnel.first_touch(_wide(s, d)),
        "funnel_flags_strict": lambda s, d: funnel.strict_flags(funnel.first_touch(_wide(s, d)), fx.LOG_TZ),
        "funnel_flags_loose": lambda s, d: funnel.loose_flags(funnel.first_touch(_wide(s, d)), fx.LOG_TZ),
        "funnel_events": lambda s, d: funnel.stage_events(
            funnel.strict_flags(funnel.first_touch(_wide(s, d)), fx.LOG_TZ)),
        "funnel_strict": _strict,
        "funnel_loose": _loose,
        "funnel_totals": lambda s, d: funnel.funnel_totals(_strict(s, d), LOG_START, LOG_END),
        "funnel_totals_loose": lambda s, d: funnel.funnel_totals(_loose(s, d), LOG_START, LOG_END),
        "funnel_long": lambda s, d: funnel.funnel_long(funnel.funnel_totals(_strict(s, d), LOG_START, LOG_END)),
        "funnel_strict_incremental": _incremental("strict"),
        "funnel_loose_incremental": _incremental("loose"),
        # cohorts
        "user_cohorts": lambda s, d: cohort.user_cohorts(_wide(s, d)),
        "cohort_sizes": lambda s, d: cohort.cohort_sizes(_wide(s, d)),
        "cohort_matrix": lambda s, d: cohort.cohort_matrix(_wide(s, d)),
        "cohort_read": lambda s, d: cohort.cohort_read(cohort.cohort_matrix(_wide(s, d)), LOG_START, LOG_END),
        "retention_rates": lambda s, d: cohort.retention_rates(
            cohort.cohort_read(cohort.cohort_matrix(_wide(s, d)), LOG_START, LOG_END)),
        "retention_grid": lambda s, d: cohort.retention_grid(cohort.cohort_matrix(_wide(s, d))),
        "retention_wide": lambda s, d: cohort.retention_wide(cohort.cohort_matrix(_wide(s, d))),
        "last_cohorts": lambda s, d: cohort.last_cohorts(cohort.cohort_matrix(_wide(s, d)), LAST_COHORTS),
        # RFM and segments
        "rfm_base": _rfm_base,
        "rfm_zscores": lambda s, d: rfm.rfm_zscores(_rfm_base(s, d)),
        "segment_rule": lambda s, d: rfm.segment_rule(rfm.rfm_zscores(_rfm_base(s, d), digits=None)),
        "rfm_score": lambda s, d: rfm.rfm_score(rfm.rfm_zscores(_rfm_base(s, d), digits=None)),
        "user_rfm": lambda s, d: _segments(s, d).user_rfm,
        "kmeans_sweep": _q_kmeans_sweep,
        "cluster_profiles": _q_cluster_profiles,
        "rfm_distribution": _q_rfm_distribution,
        "rfm_distribution_rule": _q_rule_distribution,
        "rfm_distribution_bucketed": lambda s, d: rfm.rfm_distribution(*_bucketed(s, d), LOG_START, LOG_END),
        "cluster_profiles_fixed": _q_center_profiles,
        "silhouette_fixed": lambda s, d: clustering.silhouette_by_cluster(_assigned(s, d)),
        "lloyd_fixed": _q_lloyd,
        "kmeans_fixpoint": _q_kmeans_fixpoint,
        # sales queries over purchase facts
        "core_metrics": lambda s, d: sales.core_metrics(_sales(s, d, *_DAILY), SPAN_START, SPAN_END),
        "trend_day": lambda s, d: sales.trend(_sales(s, d, *_DAILY), SPAN_START, SPAN_END, "day"),
        "trend_week": lambda s, d: sales.trend(_sales(s, d, *_DAILY), SPAN_START, SPAN_END, "week"),
        "trend_month": lambda s, d: sales.trend(_sales(s, d, *_DAILY), SPAN_START, SPAN_END, "month"),
        "comparison_sales": lambda s, d: sales.comparison_sales(_sales(s, d, "date", "price"), *PREV_MONTH),
        "top_items": lambda s, d: sales.top_items(_sales(s, d, "date", "item_id", "price"), SPAN_START, SPAN_END),
        "top_categories": lambda s, d: sales.top_categories(_sales(s, d, "date", "category_id", "price"), SPAN_START, SPAN_END),
        "sales_by_channel": lambda s, d: sales.sales_by(_sales(s, d, "date", "channel", "price"), SPAN_START, SPAN_END, "channel"),
        "sales_by_age_group": lambda s, d: sales.sales_by(_sales(s, d, "date", "age_group", "price"), SPAN_START, SPAN_END, "age_group"),
        "date_range": lambda s, d: sales.date_range(_sales(s, d, "date")),
        "trend_default_range": _q_trend_default,
        "default_range": lambda s, d: sales.default_range(_sales(s, d, "date")),
        "growth_day": lambda s, d: sales.growth(_sales(s, d, *_DAILY), MONTH_START, MONTH_END, "day"),
        "growth_week": lambda s, d: sales.growth(_sales(s, d, *_DAILY), MONTH_START, MONTH_END, "week"),
        "growth_month": lambda s, d: sales.growth(_sales(s, d, *_DAILY), MONTH_START, MONTH_END, "month"),
        "dimension_breakdown": lambda s, d: sales.dimension_breakdown(_sales(s, d), SPAN_START, SPAN_END),
        "dimension_share": lambda s, d: sales.dimension_share(_sales(s, d), SPAN_START, SPAN_END),
        "kpi_summary": _q_kpi_summary,
        "dashboard_bundle": lambda s, d: _bundle(s, d, LOG_START, LOG_END, "week"),
        "daily_drilldown": lambda s, d: _bundle(s, d, DRILL_DAY, DRILL_DAY, "day"),
        # pre-aggregated marts: the cube and mergeable sets
        "sales_cells": lambda s, d: cube.sales_cells(_sales(s, d)).withColumn("sales", F.col("sales").cast("double")),
        "set_trend_day": lambda s, d: cube.set_trend(_order_sets(s, d), SPAN_START, SPAN_END, "day"),
        "set_trend_week": lambda s, d: cube.set_trend(_order_sets(s, d), SPAN_START, SPAN_END, "week"),
        "set_trend_month": lambda s, d: cube.set_trend(_order_sets(s, d), SPAN_START, SPAN_END, "month"),
        "set_core_metrics": lambda s, d: cube.set_core(_order_sets(s, d), SPAN_START, SPAN_END),
        "set_growth_month": lambda s, d: cube.set_growth(_order_sets(s, d), MONTH_START, MONTH_END, "month"),
        "set_rfm_distribution": lambda s, d: cube.set_distribution(_buyer_sets(s, d), LOG_START, LOG_END),
        "cube_slices": lambda s, d: cube.ranked_slices(cube.sales_cells(_sales(s, d)), SPAN_START, SPAN_END),
        # log profiling
        "daily_volume": lambda s, d: profile.daily_volume(_log(s, d), fx.LOG_TZ),
        "hourly_volume": lambda s, d: profile.hourly_volume(s, _log(s, d)),
        "pareto_share": lambda s, d: profile.pareto_share(_log(s, d)),
        "stage_conversion": lambda s, d: profile.stage_conversion(_log(s, d)),
        "events_by_time": lambda s, d: profile.events_by_time(_log(s, d)),
        # scalar helpers, ad-hoc SQL, sinks
        "safe_cast": _q_safe_cast,
        "adhoc_sql": _q_adhoc,
        "publish_roundtrip": _q_read_back("buy_fact"),
        "publish_funnel_strict": _q_read_back("user_funnel_mart"),
        "publish_funnel_loose": _q_read_back("user_funnel_loose_mart"),
        "publish_cohort_matrix": _q_read_back("cohort_matrix"),
        "publish_user_rfm": _q_read_back("user_rfm"),
        "dq_log": _q_dq_log,
        "dq_log_append": _q_dq_log_append,
        # incremental ingest (Structured Streaming)
        "stream_buy_fact": _q_stream_buy_fact,
        "stream_daily_volume": _q_stream_daily_volume,
    }
    return q


# Registered keys without a DuckDB twin (rows-only check by the driver).
ROWS_ONLY = ("user_rfm", "kmeans_sweep", "cluster_profiles", "rfm_distribution", "dq_log")
