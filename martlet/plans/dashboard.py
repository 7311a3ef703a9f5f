"""Whole-dashboard bundle for one date range, and the one-day drill-down.

``dashboard_sections`` returns each section as its own DataFrame; all the
in-range sales sections read one filtered fact slice, and the previous-period
and last-year sums come from the single growth aggregation. The sections are
meant to read published marts, which are small beside the log and pruned by
column and date. ``bundle_long`` stacks them into one tidy (section, name,
value) table.

``cube_marts`` are the pre-aggregated marts kept beside the facts, and
``cube_bundle`` gives the same table from them: the cube is read once, sums and
distinct counts come from daily sets (``operators.cube``), facts are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FUNNEL_STAGE_NAMES, PERIOD_LABELS, TOP_K
from ..functions.dates import check_period, check_range, key_label, parse_date
from ..operators import cohort, cube, funnel, rfm, sales


def dashboard_sections(facts: DataFrame, funnel_mart: DataFrame, cohort_matrix: DataFrame,
                       start, end, period: str = "day", user_rfm: DataFrame | None = None) -> dict:
    """Every dashboard section for one range, each as its own DataFrame."""
    check_period(period)
    s, e = check_range(start, end)
    in_range = sales.in_range(facts, s, e)
    totals = funnel.funnel_totals(funnel_mart, s, e)
    out = {
        "date_range": sales.date_range(facts),
        "core": sales.kpi_summary(facts, funnel_mart, s, e, period),
        "trend": sales.trend(in_range, s, e, period),
        "funnel": funnel.funnel_long(totals),
        "rankings": sales.top_items(in_range, s, e, TOP_K),
        "dimensions": sales.dimension_breakdown(in_range, s, e, TOP_K),
        "retention": cohort.retention_rates(cohort.cohort_read(cohort_matrix, s, e)),
    }
    if user_rfm is not None:
        out["rfm"] = rfm.rfm_distribution(in_range, user_rfm, s, e).select(
            F.col("rfm_label").alias("name"), F.col("cnt").alias("value"))
    return out


# The stacking expressions are SQL text: one parse each instead of a call into
# the JVM per column, which is what a short query's time would go to.

def _long(section: str, name: str, value: str) -> str:
    return f"struct('{section}' AS section, {name} AS name, CAST({value} AS DOUBLE) AS value)"


def _core_long(core: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """KPI values, the period's label with a constant, and ``more`` rows."""
    cols = ["total_sales", "total_orders", "paying_users", "avg_order_value", "qoq_rate", "yoy_rate"]
    rows = [_long("core", f"'{c}'", c) for c in cols] + [_long("period", "period_label", "1"), *more]
    return core.selectExpr(f"inline(array({', '.join(rows)}))")


def _trend_long(trend: DataFrame) -> DataFrame:
    return trend.selectExpr(f"inline(array({_long('trend_sales', 'dt', 'sales')}, {_long('trend_orders', 'dt', 'orders')}))")


def _range_long(span: DataFrame) -> DataFrame:
    """Dates as days since 1970-01-01."""
    rows = [_long("date_range", f"'{c}'", f"datediff({c}, DATE'1970-01-01')") for c in ("min_date", "max_date")]
    return span.selectExpr(f"inline(array({', '.join(rows)}))")


def _funnel_long(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("'funnel' AS section", "name", "CAST(value AS DOUBLE) AS value")


def _retention_long(rates: DataFrame) -> DataFrame:
    return rates.selectExpr("'retention' AS section", "concat_ws(':', cohort_date, CAST(day_diff AS STRING)) AS name",
                            "CAST(retention_pct AS DOUBLE) AS value")


def bundle_long(sections: dict) -> DataFrame:
    """Numeric sections stacked into one (section, name, value) table."""
    parts = [
        _core_long(sections["core"]), _trend_long(sections["trend"]), _range_long(sections["date_range"]),
        _funnel_long(sections["funnel"]),
        sections["rankings"].select(F.lit("rankings").alias("section"), F.col("item_label").alias("name"),
                                    F.col("sales").alias("value")),
        sections["dimensions"].select(F.col("dimension").alias("section"), "name", F.col("sales").alias("value")),
        _retention_long(sections["retention"]),
    ]
    if "rfm" in sections:
        parts.append(sections["rfm"].select(F.lit("rfm").alias("section"), "name",
                                            F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def cube_marts(buy_fact: DataFrame, user_rfm: DataFrame | None = None) -> dict:
    """The marts that serve the dashboard without the facts, by name."""
    out = {"sales_cells": cube.sales_cells(buy_fact),
           "day_orders": cube.member_sets(buy_fact, cube.dense_numbers(buy_fact, "order_id"), "order_id")}
    if user_rfm is not None:
        labelled = buy_fact.select("date", "user_id", "price").join(user_rfm, "user_id")
        out["day_buyers"] = cube.member_sets(labelled, cube.dense_numbers(buy_fact, "user_id"), "user_id", "rfm_label")
    return out


def cube_bundle(cells: DataFrame, day_orders: DataFrame, funnel_mart: DataFrame, cohort_matrix: DataFrame,
                start, end, period: str = "day", day_buyers: DataFrame | None = None) -> DataFrame:
    """``bundle_long`` of the range from the pre-aggregated marts."""
    check_period(period)
    s, e = check_range(start, end)
    # the stage sums are one row that the KPIs and the funnel share; nothing is
    # sorted, as the stacked table has no order
    stages = funnel.stage_totals(funnel_mart, s, e).selectExpr("struct(pv, cart, buy) AS stages").scalar()
    core = cube.set_growth(day_orders, s, e, period).withColumn("_stages", stages).selectExpr(
        "total_sales", "total_orders", "_stages.buy AS paying_users",
        "coalesce(round(total_sales / nullif(CAST(total_orders AS DOUBLE), 0.0D), 2), 0.0D) AS avg_order_value",
        "qoq_rate", "yoy_rate", f"'{PERIOD_LABELS[period]}' AS period_label", "_stages.pv", "_stages.cart", "_stages.buy")
    trend = cube.set_buckets(day_orders, s, e, period).select(
        key_label("_k", period).alias("dt"), "sales", F.col("members_count").alias("orders"))
    parts = [
        _core_long(core, tuple(_long("funnel", f"'{name}'", c) for name, c in zip(FUNNEL_STAGE_NAMES, ("pv", "cart", "buy")))),
        _trend_long(trend),
        _range_long(sales.date_range(day_orders)),
        cube.ranked_slices(cells, s, e, TOP_K),
        _retention_long(cohort.retention_rates(cohort.cohorts_in(cohort_matrix, s, e))),
    ]
    if day_buyers is not None:
        parts.append(cube.set_distribution(day_buyers, s, e).selectExpr(
            "'rfm' AS section", "rfm_label AS name", "CAST(cnt AS DOUBLE) AS value"))
    return reduce(DataFrame.unionByName, parts)


def daily_drilldown(facts: DataFrame, funnel_mart: DataFrame, cohort_matrix: DataFrame,
                    day, period: str = "day", user_rfm: DataFrame | None = None) -> dict:
    """The dashboard sections for a single day."""
    d = parse_date(day)
    return dashboard_sections(facts, funnel_mart, cohort_matrix, d, d, period, user_rfm)


class Dashboard:
    """The dashboard's entry points over a set of marts, each returning a
    DataFrame: core KPIs, trend, funnel, rankings, dimensions, segments,
    retention, and the whole bundle.

    If either bound of a range is missing, the range becomes (last fact date -
    30 days, last fact date), as scalar subqueries: no job runs when a section
    is defined, and date folders are pruned at run time.
    """

    def __init__(self, buy_fact: DataFrame, funnel_mart: DataFrame, cohort_matrix: DataFrame,
                 user_rfm: DataFrame | None = None, cubes: dict | None = None):
        self.facts, self.funnel_mart, self.cohort_matrix = buy_fact, funnel_mart, cohort_matrix
        self.user_rfm, self.cubes = user_rfm, cubes or {}

    @classmethod
    def from_published(cls, spark, root: str) -> "Dashboard":
        from ..sinks.publish import read_marts
        names = ("buy_fact", "user_funnel_mart", "cohort_matrix", "user_rfm")
        cubes = ("sales_cells", "day_orders", "day_buyers")
        marts = read_marts(spark, root, names + cubes)
        missing = [n for n in names[:3] if n not in marts]
        if missing:
            raise KeyError(f"marts {missing} have not been published under {root}")
        return cls(*[marts.get(n) for n in names], {n: marts[n] for n in cubes if n in marts})

    def resolve(self, start=None, end=None) -> tuple:
        if start and end:
            return check_range(start, end)
        return sales.default_bounds(self.cubes.get("day_orders", self.facts))

    def date_range(self) -> DataFrame:
        return sales.date_range(self.facts)

    def core(self, start=None, end=None, period: str = "day") -> DataFrame:
        check_period(period)
        s, e = self.resolve(start, end)
        return sales.kpi_summary(self.facts, self.funnel_mart, s, e, period)

    def trend(self, start=None, end=None, period: str = "day") -> DataFrame:
        check_period(period)
        s, e = self.resolve(start, end)
        return sales.trend(self.facts, s, e, period)

    def funnel(self, start=None, end=None) -> DataFrame:
        s, e = self.resolve(start, end)
        return funnel.funnel_long(funnel.funnel_totals(self.funnel_mart, s, e))

    def rankings(self, start=None, end=None) -> DataFrame:
        s, e = self.resolve(start, end)
        return sales.top_items(self.facts, s, e, TOP_K)

    def dimensions(self, start=None, end=None) -> DataFrame:
        s, e = self.resolve(start, end)
        return sales.dimension_breakdown(self.facts, s, e, TOP_K)

    def rfm(self, start=None, end=None) -> DataFrame:
        if self.user_rfm is None:
            raise ValueError("no segment table published")
        s, e = self.resolve(start, end)
        return rfm.segment_rows(rfm.rfm_distribution(self.facts, self.user_rfm, s, e))

    def retention(self, start=None, end=None) -> DataFrame:
        s, e = self.resolve(start, end)
        return cohort.retention_rates(cohort.cohort_read(self.cohort_matrix, s, e))

    def all(self, start=None, end=None, period: str = "day") -> dict:
        check_period(period)
        s, e = self.resolve(start, end)
        return dashboard_sections(self.facts, self.funnel_mart, self.cohort_matrix, s, e, period,
                                  self.user_rfm)

    def bundle(self, start=None, end=None, period: str = "day") -> DataFrame:
        """All sections in one (section, name, value) table, from the
        pre-aggregated marts where they are published."""
        check_period(period)
        s, e = self.resolve(start, end)
        if "sales_cells" in self.cubes and "day_orders" in self.cubes and (
                self.user_rfm is None or "day_buyers" in self.cubes):
            return cube_bundle(self.cubes["sales_cells"], self.cubes["day_orders"], self.funnel_mart,
                               self.cohort_matrix, s, e, period, self.cubes.get("day_buyers"))
        return bundle_long(self.all(s, e, period))
