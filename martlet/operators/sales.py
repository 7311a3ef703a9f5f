"""Sales queries over purchase facts (``buy_fact`` shape).

Every query takes an inclusive date range; Catalyst pushes the range to the
Parquet scan (and prunes ``date`` partitions of a published mart). Money is
summed as DECIMAL and turned into DOUBLE only at the edge, so totals are
exact before they leave the aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import (CATEGORY_PREFIX, DEFAULT_LOOKBACK_DAYS, ITEM_PREFIX,
                         PERIOD_LABELS, TOP_K)
from ..functions.dates import check_range, comparison_windows, key_label, period_key


def between(start, end, col: str = "date") -> Column:
    s, e = check_range(start, end)
    return F.col(col).between(F.lit(s), F.lit(e))


def in_range(facts: DataFrame, start, end) -> DataFrame:
    """Fact rows dated inside the inclusive range."""
    return facts.filter(between(start, end))


def money(c: Column) -> Column:
    """Exact decimal sum -> double at the edge."""
    return c.cast("double")


def core_metrics(facts: DataFrame, start, end) -> DataFrame:
    """Total sales (0.0 when empty) and distinct orders in the range."""
    return in_range(facts, start, end).agg(
        F.coalesce(money(F.sum("price")), F.lit(0.0)).alias("total_sales"),
        F.count_distinct("order_id").alias("total_orders"),
    )


def trend(facts: DataFrame, start, end, period: str = "day") -> DataFrame:
    """Sales and distinct orders per day / week / month bucket, in order."""
    return (in_range(facts, start, end)
            .groupBy(period_key("date", period).alias("_k"))
            .agg(money(F.sum("price")).alias("sales"),
                 F.count_distinct("order_id").alias("orders"))
            .orderBy("_k")
            .select(key_label("_k", period).alias("dt"), "sales", "orders"))


def trend_arrays(trend_rows: DataFrame) -> DataFrame:
    """The chart shape: one row of parallel arrays (dates, sales, orders).
    A trend has one row per bucket of the requested range, so the arrays are
    bounded by the range length, not by the data size."""
    ordered = F.sort_array(F.collect_list(F.struct("dt", "sales", "orders")))
    return trend_rows.agg(ordered.alias("_t")).select(
        F.col("_t.dt").alias("dates"), F.col("_t.sales").alias("sales"), F.col("_t.orders").alias("orders"))


def comparison_sales(facts: DataFrame, start, end) -> DataFrame:
    """Sales in a comparison window; NULL (not 0) when the window is empty."""
    return in_range(facts, start, end).agg(money(F.sum("price")).alias("sales"))


def _top(facts: DataFrame, start, end, key: str, prefix: str, label: str, k: int) -> DataFrame:
    ranked = (in_range(facts, start, end).groupBy(key)
              .agg(F.sum("price").alias("_sales"))
              .orderBy(F.col("_sales").desc(), F.col(key).asc_nulls_last())
              .limit(k))
    order = Window.orderBy(F.col("_sales").desc(), F.col(key).asc_nulls_last())
    return ranked.select(
        F.row_number().over(order).alias("rank"),
        key,
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias(label),
        money(F.col("_sales")).alias("sales"),
    )


def top_items(facts: DataFrame, start, end, k: int = TOP_K) -> DataFrame:
    """Top-k items by sales, ties broken by item id (per-task top-k, then
    one k-row merge: TakeOrderedAndProject)."""
    return _top(facts, start, end, "item_id", ITEM_PREFIX, "item_label", k)


def top_categories(facts: DataFrame, start, end, k: int = TOP_K) -> DataFrame:
    """Top-k categories by sales, ties broken by category id."""
    return _top(facts, start, end, "category_id", CATEGORY_PREFIX, "category_label", k)


def sales_by(facts: DataFrame, start, end, dim: str) -> DataFrame:
    """Sales per channel or age band, largest first."""
    if dim not in ("channel", "age_group"):
        raise ValueError("dim must be 'channel' or 'age_group'")
    return (in_range(facts, start, end).groupBy(dim)
            .agg(F.sum("price").alias("_s"))
            .orderBy(F.col("_s").desc(), F.col(dim).asc_nulls_last())
            .select(dim, money(F.col("_s")).alias("sales")))


def date_range(facts: DataFrame) -> DataFrame:
    """Min / max fact date; today's date for an empty table."""
    return facts.agg(
        F.coalesce(F.min("date"), F.current_date()).alias("min_date"),
        F.coalesce(F.max("date"), F.current_date()).alias("max_date"),
    )


def default_range(facts: DataFrame, start=None, end=None,
                  lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> DataFrame:
    """If either bound is missing both are replaced: end = last fact date,
    start = end - lookback. Given bounds are validated as calendar dates."""
    if start and end:
        s, e = check_range(start, end)
        return date_range(facts).select(F.lit(s).alias("start_date"), F.lit(e).alias("end_date"))
    return date_range(facts).select(
        F.date_sub("max_date", lookback_days).alias("start_date"),
        F.col("max_date").alias("end_date"),
    )


def default_bounds(facts: DataFrame, lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> tuple[Column, Column]:
    """The default range as scalar subqueries: nothing runs when a query over it
    is defined, and the dates prune partitions and row groups at run time."""
    row = default_range(facts, lookback_days=lookback_days).select(F.struct("start_date", "end_date").alias("r")).scalar()
    return row["start_date"], row["end_date"]


def growth(facts: DataFrame, start, end, period: str = "day") -> DataFrame:
    """Current, previous-period and last-year sales in ONE conditional
    aggregation (the scan reads the union of the three windows)."""
    w = comparison_windows(start, end, period)
    cur, prev, ly = (between(*w["current"]), between(*w["previous"]), between(*w["last_year"]))
    agg = facts.filter(cur | prev | ly).agg(
        F.sum(F.when(cur, F.col("price"))).alias("_cur"),
        F.sum(F.when(prev, F.col("price"))).alias("_prev"),
        F.sum(F.when(ly, F.col("price"))).alias("_ly"),
        F.count_distinct(F.when(cur, F.col("order_id"))).alias("total_orders"),
    )
    return growth_row(agg, w, period)


def growth_row(agg: DataFrame, w: dict, period: str) -> DataFrame:
    """The growth columns of one row of window sums ``_cur, _prev, _ly`` and
    ``total_orders``."""
    rate = "round((total_sales - {0}) / nullif({0}, 0.0D) * 100, 2) AS {1}".format
    sums = agg.selectExpr("round(coalesce(CAST(_cur AS DOUBLE), 0.0D), 2) AS total_sales", "total_orders",
                          "CAST(_prev AS DOUBLE) AS prev_sales", "CAST(_ly AS DOUBLE) AS ly_sales")
    return sums.selectExpr(
        f"'{period}' AS period",
        "total_sales", "total_orders", "prev_sales", "ly_sales",
        rate("prev_sales", "qoq_rate"), rate("ly_sales", "yoy_rate")).withColumns(dict(zip(
            ("prev_start", "prev_end", "ly_start", "ly_end"), map(F.lit, (*w["previous"], *w["last_year"])))))


def kpi_summary(facts: DataFrame, funnel: DataFrame, start, end, period: str = "day") -> DataFrame:
    """Sales, orders, paying users (strict-funnel buy user-days) and their
    distinct count, average order value, growth rates, period label.

    Facts give one aggregate row; the funnel totals join it as a scalar
    subquery (one row), so no join of the fact table is needed.
    """
    from .funnel import funnel_totals
    return kpi_row(growth(facts, start, end, period), funnel_totals(funnel, start, end), period)


def kpi_row(g: DataFrame, totals: DataFrame, period: str) -> DataFrame:
    """The KPI row of one growth row and one row of funnel totals."""
    buys = totals.select(F.struct("buy", "distinct_buyers").alias("s")).scalar()
    return g.withColumn("_buys", buys).selectExpr(
        "total_sales", "total_orders", "_buys.buy AS paying_users", "_buys.distinct_buyers AS distinct_paying_users",
        "coalesce(round(total_sales / nullif(CAST(total_orders AS DOUBLE), 0.0D), 2), 0.0D) AS avg_order_value",
        "qoq_rate", "yoy_rate", f"'{PERIOD_LABELS[period]}' AS period_label")


def _cells(facts: DataFrame, start, end) -> DataFrame:
    """Sales per (category, channel, age band): one scan and one partial
    aggregate that the three breakdowns and the total share."""
    return (in_range(facts, start, end).groupBy("category_id", "channel", "age_group")
            .agg(F.sum("price").alias("_s")))


def _breakdown(cells: DataFrame, top_k: int) -> DataFrame:
    def ranked(dimension: str, key: str, name: Column, k: int | None = None) -> DataFrame:
        g = cells.groupBy(key).agg(F.sum("_s").alias("_s"))
        order = [F.col("_s").desc(), F.col(key).asc_nulls_last()]
        if k is not None:
            g = g.orderBy(*order).limit(k)   # per-task top-k and one merge of k rows
        return g.select(F.lit(dimension).alias("dimension"), name.alias("name"),
                        money(F.col("_s")).alias("sales"),
                        F.row_number().over(Window.orderBy(*order)).alias("rank"))
    return (ranked("category", "category_id",
                   F.concat(F.lit(CATEGORY_PREFIX), F.col("category_id").cast("string")), top_k)
            .unionByName(ranked("channel", "channel", F.col("channel")))
            .unionByName(ranked("age_group", "age_group", F.col("age_group"))))


def dimension_breakdown(facts: DataFrame, start, end, top_k: int = TOP_K) -> DataFrame:
    """Sales by category (top-k), channel and age band over a single scan.
    Output (dimension, name, sales, rank). Channels and age bands are few;
    categories are cut to the top k before they meet in one task."""
    return _breakdown(_cells(facts, start, end), top_k)


def ranking_axis(top: DataFrame) -> DataFrame:
    """Top-k rows in bar-axis order (smallest first)."""
    return top.orderBy(F.col("rank").desc())


def dimension_share(facts: DataFrame, start, end, top_k: int = TOP_K) -> DataFrame:
    """The breakdown with each slice's share, in percent, of all sales in the
    range (also of the categories beyond the top k)."""
    cells = _cells(facts, start, end)
    total = cells.select(money(F.sum("_s"))).scalar()
    return _breakdown(cells, top_k).withColumn(
        "share_pct", F.round(F.col("sales") / F.nullif(total, F.lit(0.0)) * 100, 2))
