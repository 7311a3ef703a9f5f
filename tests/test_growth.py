import datetime as dt
from decimal import Decimal

import pytest

from martlet import schemas
from martlet.functions.dates import comparison_windows
from martlet.operators import sales


def windows(start, end, period):
    return {k: tuple(map(str, v)) for k, v in comparison_windows(start, end, period).items()}


def test_every_window_is_the_current_one_moved_back():
    w = windows("2022-03-07", "2022-03-13", "day")       # a week: moved by its seven days
    assert w == {"current": ("2022-03-07", "2022-03-13"), "previous": ("2022-02-28", "2022-03-06"),
                 "last_year": ("2021-03-07", "2021-03-13")}
    assert windows("2022-03-07", "2022-03-07", "day")["previous"] == ("2022-03-06", "2022-03-06")
    assert windows("2022-03-01", "2022-03-20", "week")["previous"] == ("2022-02-22", "2022-03-13")
    assert windows("2022-01-15", "2022-01-25", "month")["previous"] == ("2021-12-15", "2021-12-25")


def test_month_ends_are_clamped():
    assert windows("2024-05-31", "2024-05-31", "month")["previous"] == ("2024-04-30", "2024-04-30")
    assert windows("2024-02-29", "2024-02-29", "week")["last_year"] == ("2023-02-28", "2023-02-28")


def test_reversed_window_is_refused():
    with pytest.raises(ValueError):
        comparison_windows("2022-03-13", "2022-03-07", "day")


def day_sales(spark, amounts):
    rows = [(dt.date.fromisoformat(day), 3, f"n{i}", 9, 4, Decimal(str(a)), "web", "46+")
            for i, (day, a) in enumerate(amounts.items()) if a is not None]
    return spark.createDataFrame(rows, schemas.BUY_FACT)


@pytest.mark.parametrize("now,before,year_ago,qoq,yoy", [
    (240, 160, 300, 50.0, -20.0),
    (75, 100, 60, -25.0, 25.0),
    (80, 80, 80, 0.0, 0.0),
    (10, None, 40, None, -75.0),      # nothing to compare with
    (10, 0, 0, None, None),           # zero is no base either
    (1, 3, None, -66.67, None),
])
def test_rates(spark, now, before, year_ago, qoq, yoy):
    f = day_sales(spark, {"2022-03-09": now, "2022-03-02": before, "2021-03-09": year_ago})
    r = sales.growth(f, "2022-03-07", "2022-03-13", "week").first()
    assert (r.total_sales, r.qoq_rate, r.yoy_rate) == (float(now), qoq, yoy)


def test_kpi_summary(buy_fact, funnel_mart):
    r = sales.kpi_summary(buy_fact, funnel_mart, "2021-05-03", "2021-05-09", "month").first()
    assert (r.total_sales, r.total_orders, r.avg_order_value) == (59.75, 2, 29.88)
    assert (r.paying_users, r.distinct_paying_users, r.period_label) == (2, 1, "月")
    assert r.qoq_rate is None and r.yoy_rate is None


def test_kpi_summary_of_an_empty_range(buy_fact, funnel_mart):
    r = sales.kpi_summary(buy_fact, funnel_mart, "2020-01-01", "2020-01-05", "day").first()
    assert (r.total_sales, r.total_orders, r.avg_order_value, r.paying_users) == (0.0, 0, 0.0, 0)
