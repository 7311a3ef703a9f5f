import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlet import schemas
from martlet.operators import sales
from martlet.operators.funnel import funnel_totals

MAY = ("2021-05-01", "2021-05-31")
ALL = ("2021-05-01", "2021-06-30")


def test_core_metrics_count_orders_not_lines(buy_fact):
    r = sales.core_metrics(buy_fact, *MAY).first()
    assert r.total_sales == 99.75 and r.total_orders == 3
    assert sales.core_metrics(buy_fact, *ALL).first().total_sales == 199.75


def test_bounds_are_inclusive_and_empty_is_zero(buy_fact):
    assert sales.core_metrics(buy_fact, "2021-05-10", "2021-06-01").first().total_sales == 140.0
    r = sales.core_metrics(buy_fact, "2021-05-11", "2021-05-31").first()
    assert (r.total_sales, r.total_orders) == (0.0, 0)


def test_reversed_range_is_refused(buy_fact, funnel_mart):
    for call in (lambda: sales.core_metrics(buy_fact, "2021-06-01", "2021-05-01"),
                 lambda: sales.default_range(buy_fact, "2021-06-01", "2021-05-01"),
                 lambda: funnel_totals(funnel_mart, "2021-06-01", "2021-05-01")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("period,expected", [
    ("day", [("2021-05-03", 59.75, 2), ("2021-05-10", 40.0, 1), ("2021-06-01", 100.0, 1)]),
    ("week", [("2021-18", 59.75, 2), ("2021-19", 40.0, 1), ("2021-22", 100.0, 1)]),
    ("month", [("2021-05", 99.75, 3), ("2021-06", 100.0, 1)]),
])
def test_trend(buy_fact, period, expected):
    assert [(r.dt, r.sales, r.orders) for r in sales.trend(buy_fact, *ALL, period).collect()] == expected


def test_unknown_period(buy_fact):
    with pytest.raises(ValueError):
        sales.trend(buy_fact, *ALL, "quarter")


def test_comparison_sales_without_rows_is_null(buy_fact):
    assert sales.comparison_sales(buy_fact, "2021-07-01", "2021-07-31").first().sales is None
    assert sales.comparison_sales(buy_fact, "2021-06-01", "2021-06-01").first().sales == 100.0


def test_date_range(buy_fact):
    r = sales.date_range(buy_fact).first()
    assert (str(r.min_date), str(r.max_date)) == ("2021-05-03", "2021-06-01")
    before = dt.date.today()
    r = sales.date_range(buy_fact.filter(F.lit(False))).first()
    assert r.min_date == r.max_date
    assert before - dt.timedelta(days=1) <= r.min_date <= dt.date.today() + dt.timedelta(days=1)


def test_default_range(buy_fact):
    r = sales.default_range(buy_fact).first()
    assert (str(r.start_date), str(r.end_date)) == ("2021-05-02", "2021-06-01")
    r = sales.default_range(buy_fact, "2021-05-03", "2021-05-04").first()
    assert (str(r.start_date), str(r.end_date)) == ("2021-05-03", "2021-05-04")
    with pytest.raises(ValueError):
        sales.default_range(buy_fact, "03.05.2021", "2021-05-04")


def test_rankings_break_ties_by_key(buy_fact):
    rows = sales.top_items(buy_fact, *ALL).collect()
    assert [(r.rank, r.item_id, r.sales) for r in rows] == [(1, 504, 100.0), (2, 502, 80.0), (3, 501, 12.5), (4, 503, 7.25)]
    assert rows[1].item_label == "商品502"
    assert [r.item_id for r in sales.ranking_axis(sales.top_items(buy_fact, *ALL, k=2)).collect()] == [502, 504]
    # equal sales of two categories: the smaller id comes first
    tied = buy_fact.filter("item_id IN (502, 504)").withColumn("price", F.lit(Decimal("5.00")).cast("decimal(10,2)"))
    assert [r.category_id for r in sales.top_categories(tied.limit(0).union(tied.filter("order_id IN ('A3', 'A4')")), *ALL).collect()] == [32, 33]


def test_sales_by(buy_fact):
    assert [(r.channel, r.sales) for r in sales.sales_by(buy_fact, *MAY, "channel").collect()] == [
        ("app", 47.25), ("store", 40.0), ("web", 12.5)]
    with pytest.raises(ValueError):
        sales.sales_by(buy_fact, *MAY, "item_id")


def test_funnel_totals(funnel_mart):
    r = funnel_totals(funnel_mart, *MAY).first()
    assert (r.pv, r.cart, r.buy, r.distinct_buyers) == (4, 3, 2, 1)
    r = funnel_totals(funnel_mart, "2021-05-06", "2021-05-07").first()
    assert (r.pv, r.cart, r.buy, r.distinct_buyers) == (0, 0, 0, 0)


def test_dimension_breakdown(buy_fact):
    rows = {(r.dimension, r.name): (r.sales, r.rank) for r in sales.dimension_breakdown(buy_fact, *MAY).collect()}
    assert rows == {("category", "品类32"): (87.25, 1), ("category", "品类31"): (12.5, 2),
                    ("channel", "app"): (47.25, 1), ("channel", "store"): (40.0, 2), ("channel", "web"): (12.5, 3),
                    ("age_group", "25-34"): (47.25, 1), ("age_group", "46+"): (40.0, 2), ("age_group", "18-24"): (12.5, 3)}


def test_share_is_of_all_categories_not_of_the_top(spark):
    # twenty categories of equal sales: the ten kept ones hold half
    rows = [(dt.date(2020, 1, 1), 1, f"o{i}", i, i, Decimal("3.00"), "c", "a") for i in range(20)]
    shares = sales.dimension_share(spark.createDataFrame(rows, schemas.BUY_FACT), "2020-01-01", "2020-01-01")
    top = shares.filter("dimension = 'category'").collect()
    assert len(top) == 10 and [r.name for r in sorted(top, key=lambda r: r.rank)][:2] == ["品类0", "品类1"]
    assert sum(r.share_pct for r in top) == pytest.approx(50.0)
    assert {r.share_pct for r in shares.filter("dimension <> 'category'").collect()} == {100.0}


def test_trend_arrays(buy_fact):
    r = sales.trend_arrays(sales.trend(buy_fact, *MAY, "day")).first()
    assert (r.dates, r.sales, r.orders) == (["2021-05-03", "2021-05-10"], [59.75, 40.0], [2, 1])


def test_period_key_labels_match(spark):
    from martlet.functions.dates import key_label, period_key, period_label
    start = dt.date(1999, 12, 20)
    df = spark.createDataFrame([(start + dt.timedelta(days=i),) for i in range(800)], "d date")
    for p in ("day", "week", "month"):
        rows = df.select(period_label("d", p).alias("a"), key_label(period_key("d", p), p).alias("b")).collect()
        assert all(r.a == r.b for r in rows), p
