from decimal import Decimal

from martlet import schemas
from martlet.operators import clean, cohort, funnel
from conftest import ts

USERS = [(1, "18-24", "web"), (2, None, None), (3, "25-34", "app")]
ITEMS = [(10, 1, Decimal("5.00")), (11, 1, Decimal("7.50")), (12, 1, None)]


def log_df(spark, rows):
    return spark.createDataFrame([(u, i, 1, t, ts(s)) for u, i, t, s in rows], schemas.BEHAVIOR)


def wide_of(spark, rows):
    return clean.load_and_clean(log_df(spark, rows), spark.createDataFrame(ITEMS, schemas.ITEMS),
                                spark.createDataFrame(USERS, schemas.USERS), ("2024-01-01", "2024-01-31")).wide


def flags(spark, rows, strict=True):
    touch = funnel.first_touch(wide_of(spark, rows))
    f = funnel.strict_flags(touch) if strict else funnel.loose_flags(touch)
    return {(r.user_id, r.item_id): (r.has_pv, r.has_cart, r.has_buy) for r in f.collect()}


def test_strict_in_order(spark):
    rows = [(1, 10, "pv", "2024-01-01 10:00:00"), (1, 10, "cart", "2024-01-01 11:00:00"),
            (1, 10, "buy", "2024-01-02 09:00:00")]
    assert flags(spark, rows)[(1, 10)] == (1, 1, 1)


def test_strict_early_cart_hides_later_path(spark):
    # first cart precedes first pv: no strict cart/buy even though pv->cart
    # happens later; loose counts everything
    rows = [(1, 10, "cart", "2024-01-01 08:00:00"), (1, 10, "pv", "2024-01-01 09:00:00"),
            (1, 10, "cart", "2024-01-01 10:00:00"), (1, 10, "buy", "2024-01-01 11:00:00")]
    assert flags(spark, rows)[(1, 10)] == (1, 0, 0)
    assert flags(spark, rows, strict=False)[(1, 10)] == (1, 1, 1)


def test_strict_same_second_counts(spark):
    rows = [(1, 10, "pv", "2024-01-01 10:00:00"), (1, 10, "cart", "2024-01-01 10:00:00"),
            (1, 10, "buy", "2024-01-01 10:00:00")]
    assert flags(spark, rows)[(1, 10)] == (1, 1, 1)


def test_buy_without_cart_not_strict(spark):
    rows = [(1, 10, "pv", "2024-01-01 10:00:00"), (1, 10, "buy", "2024-01-01 11:00:00")]
    assert flags(spark, rows)[(1, 10)] == (1, 0, 0)


def test_missing_price_rows_are_dropped(spark):
    rows = [(1, 12, "pv", "2024-01-01 10:00:00"), (1, 10, "pv", "2024-01-01 10:00:00")]
    assert set(flags(spark, rows)) == {(1, 10)}


def test_mart_counts_user_days(spark):
    # one user buys two items on two different days: 2 buy user-days, 1 buyer
    rows = [(1, 10, "pv", "2024-01-01 10:00:00"), (1, 10, "cart", "2024-01-01 10:05:00"),
            (1, 10, "buy", "2024-01-01 10:10:00"),
            (1, 11, "pv", "2024-01-02 10:00:00"), (1, 11, "cart", "2024-01-02 10:05:00"),
            (1, 11, "buy", "2024-01-02 10:10:00")]
    strict, loose = funnel.build_funnels(wide_of(spark, rows))
    t = funnel.funnel_totals(strict, "2024-01-01", "2024-01-31").first()
    assert (t.pv, t.cart, t.buy, t.distinct_buyers) == (2, 2, 2, 1)
    long = funnel.funnel_long(funnel.funnel_totals(strict, "2024-01-01", "2024-01-31")).collect()
    assert [(r.stage, r.name, r.value) for r in long] == [(1, "浏览 (PV)", 2), (2, "意向 (加购)", 2), (3, "购买 (成交)", 2)]


def test_stage_dated_on_own_day(spark):
    rows = [(1, 10, "pv", "2024-01-01 23:00:00"), (1, 10, "cart", "2024-01-02 01:00:00"),
            (1, 10, "buy", "2024-01-03 01:00:00")]
    strict, _ = funnel.build_funnels(wide_of(spark, rows))
    got = {(str(r.date), r.has_pv, r.has_cart, r.has_buy) for r in strict.collect()}
    assert got == {("2024-01-01", 1, 0, 0), ("2024-01-02", 0, 1, 0), ("2024-01-03", 0, 0, 1)}


def test_fill_defaults(spark):
    rows = [(2, 10, "pv", "2024-01-01 10:00:00")]
    r = wide_of(spark, rows).first()
    assert (r.channel, r.age_group) == ("未知渠道", "未知")


def test_window_is_inclusive(spark):
    rows = [(1, 10, "pv", "2024-01-31 23:59:59"), (1, 10, "pv", "2024-02-01 00:00:00"),
            (1, 10, "pv", "2023-12-31 23:59:59")]
    assert wide_of(spark, rows).count() == 1


def test_order_key(spark):
    rows = [(1, 10, "buy", "2024-01-01 00:00:00")]
    assert wide_of(spark, rows).first().order_id == f"1_{ts('2024-01-01 00:00:00')}_10"


COHORT_LOG = [
    (1, 10, "pv", "2024-01-01 10:00:00"), (1, 10, "pv", "2024-01-02 10:00:00"),
    (1, 10, "pv", "2024-01-09 10:00:00"), (1, 10, "pv", "2024-01-10 10:00:00"),
    (2, 10, "pv", "2024-01-01 10:00:00"), (2, 11, "pv", "2024-01-01 11:00:00"),
    (3, 10, "pv", "2024-01-02 10:00:00"), (3, 10, "pv", "2024-01-04 10:00:00"),
]


def test_cohort_matrix(spark):
    m = cohort.cohort_matrix(wide_of(spark, COHORT_LOG))
    got = {(str(r.cohort_date), r.day_diff): (r.active_users, r.cohort_users) for r in m.collect()}
    assert got == {("2024-01-01", 0): (2, 2), ("2024-01-01", 1): (1, 2),
                   ("2024-01-02", 0): (1, 1), ("2024-01-02", 2): (1, 1)}
    # day 8 and 9 fall outside the 0..7 horizon
    assert ("2024-01-01", 8) not in got


def test_cohort_matches_join_formulation(spark):
    wide = wide_of(spark, COHORT_LOG)
    sizes = {str(r.cohort_date): r.cohort_users for r in cohort.cohort_sizes(wide).collect()}
    for r in cohort.cohort_matrix(wide).collect():
        assert r.cohort_users == sizes[str(r.cohort_date)]


def test_retention_rates(spark, cohort_rows):
    rows = cohort.retention_rates(cohort_rows).collect()
    assert [(r.day_diff, r.cohort_date, r.retention_pct) for r in rows] == [
        (0, "2021-05-03", 100.0), (1, "2021-05-03", 40.0), (3, "2021-05-03", 26.0)]
    zero = spark.createDataFrame([(None, 0, 0, 0)], "cohort_date date, day_diff int, active_users long, cohort_users long")
    assert cohort.retention_rates(zero).first().retention_pct == 0.0


def test_cohort_read_and_grid(spark, cohort_rows):
    rows = cohort.cohort_read(cohort_rows, "2021-05-01", "2021-05-31").collect()
    assert len(rows) == 3 and rows[1].active_users == 20
    g = cohort.retention_grid(cohort_rows).collect()
    assert {r.row_idx for r in g} == {0}
    wide = cohort.retention_wide(cohort_rows).first()
    assert wide["0"] == 100.0 and wide["1"] == 40.0 and wide["2"] is None and wide["3"] == 26.0


def test_last_cohorts(spark):
    import datetime as dt
    rows = [(dt.date(2024, 1, d), 0, 1, 1) for d in range(1, 16)]
    m = spark.createDataFrame(rows, "cohort_date date, day_diff int, active_users long, cohort_users long")
    kept = sorted(r.cohort_date.day for r in cohort.last_cohorts(m, 10).collect())
    assert kept == list(range(6, 16))
