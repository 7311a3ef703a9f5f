"""Invariants across operators on the supplied tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from martlet.operators import clean, cohort, funnel
from martlet.sources import fixtures as fx


@pytest.fixture(scope="module")
def cl(spark):
    return clean.load_and_clean(fx.behavior_log(spark, SF_SMALL), fx.items(spark, SF_SMALL),
                                fx.users(spark, SF_SMALL), fx.LOG_WINDOW)


def test_strict_flags_never_exceed_loose(cl):
    touch = funnel.first_touch(cl.wide)
    s = funnel.strict_flags(touch).select("user_id", "item_id", *[F.col(c).alias("s_" + c) for c in
                                                                 ("has_pv", "has_cart", "has_buy")])
    lo = funnel.loose_flags(touch).select("user_id", "item_id", "has_pv", "has_cart", "has_buy")
    j = s.join(lo, ["user_id", "item_id"])
    assert j.count() == touch.count()
    bad = j.filter((F.col("s_has_pv") > F.col("has_pv")) | (F.col("s_has_cart") > F.col("has_cart"))
                   | (F.col("s_has_buy") > F.col("has_buy")))
    assert bad.count() == 0
    # strict stages are nested: buy implies cart implies pv
    nested = s.filter((F.col("s_has_buy") > F.col("s_has_cart")) | (F.col("s_has_cart") > F.col("s_has_pv")))
    assert nested.count() == 0


def test_day0_is_cohort_size(cl):
    m = cohort.cohort_matrix(cl.wide)
    day0 = m.filter("day_diff = 0")
    assert day0.filter("active_users <> cohort_users").count() == 0
    assert day0.agg(F.sum("cohort_users")).first()[0] == cl.wide.select("user_id").distinct().count()


def test_rejects_plus_clean_is_joined(cl):
    assert clean.rejected_events(cl.joined).count() + cl.wide.count() == cl.joined.count()


def test_mart_totals_bounded_by_pairs(cl):
    strict, loose = funnel.build_funnels(cl.wide)
    t_s = funnel.funnel_totals(strict, "2024-01-01", "2024-01-31").first()
    t_l = funnel.funnel_totals(loose, "2024-01-01", "2024-01-31").first()
    assert t_s.pv == t_l.pv and t_s.cart <= t_l.cart and t_s.buy <= t_l.buy
    assert t_s.distinct_buyers <= t_s.buy
