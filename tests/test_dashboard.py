"""Dashboard entry points over small marts."""

import pytest

from martlet.constants import LABEL_LOYAL, LABEL_REGULAR
from martlet.plans.dashboard import Dashboard, bundle_long, daily_drilldown


@pytest.fixture()
def dash(spark, buy_fact, funnel_mart, cohort_rows):
    segments = spark.createDataFrame([(7, LABEL_LOYAL), (8, LABEL_REGULAR)], "user_id int, rfm_label string")
    return Dashboard(buy_fact, funnel_mart, cohort_rows, segments)


def test_missing_dates_resolve_to_the_last_thirty_days(dash):
    shown = lambda r: tuple(map(str, dash.facts.select(*r).first()))
    assert shown(dash.resolve()) == shown(dash.resolve(start="2021-01-01")) == ("2021-05-02", "2021-06-01")
    for bad in (("2021-02-30", "2021-03-01"), ("2021-06-01", "2021-05-01")):
        with pytest.raises(ValueError):
            dash.resolve(*bad)


def test_sections(dash):
    may = ("2021-05-01", "2021-05-31")
    core = dash.core(*may).first()
    assert (core.total_sales, core.total_orders, core.paying_users) == (99.75, 3, 2)
    assert [r.dt for r in dash.trend(*may, period="week").collect()] == ["2021-18", "2021-19"]
    assert [r.value for r in dash.funnel(*may).collect()] == [4, 3, 2]
    assert [r.item_id for r in dash.rankings(*may).collect()] == [502, 501, 503]
    # buyer 9 has no segment
    assert {r.name: (r.value, r.share_pct) for r in dash.rfm(*may).collect()} == {
        LABEL_LOYAL: (1, 50.0), LABEL_REGULAR: (1, 50.0)}
    assert [(r.day_diff, r.retention_pct) for r in dash.retention(*may).collect()] == [(0, 100.0), (1, 40.0), (3, 26.0)]
    with pytest.raises(ValueError):
        dash.core(*may, period="hour")


def test_bundle_holds_every_section(dash):
    sections = dash.all("2021-05-01", "2021-06-30", period="month")
    assert set(sections) == {"date_range", "core", "trend", "funnel", "rankings", "dimensions", "retention", "rfm"}
    rows = {(r.section, r.name): r.value for r in bundle_long(sections).collect()}
    assert rows["core", "total_sales"] == rows["trend_sales", "2021-05"] + rows["trend_sales", "2021-06"] == 199.75
    assert rows["period", "月"] == 1.0 and rows["rfm", LABEL_LOYAL] == 1.0
    assert rows["date_range", "max_date"] - rows["date_range", "min_date"] == 29.0


def test_one_day(dash):
    day = daily_drilldown(dash.facts, dash.funnel_mart, dash.cohort_matrix, "2021-05-10")
    assert day["core"].first().total_sales == 40.0 and "rfm" not in day
