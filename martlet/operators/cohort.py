"""Cohort retention.

A user's cohort is the first date of any behaviour in the cleaned table;
``active_users`` counts distinct users active ``day_diff`` days later
(0..horizon); days without a returning user produce no row.

Plan: reduce the log to distinct (user, date) first (map-side partial
aggregation, so a user holding a third of all rows still ships at most one
row per active day per task), take each user's first date with a window over
that reduced set (at most one row per active day per user), and count cells.
Because (user, date) is already distinct, ``count(*)`` per cell is the exact
distinct-user count, and the day-0 cell of a cohort equals its size — no
self-join of the fact table and no second pass for cohort sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LAST_COHORTS, RETENTION_HORIZON_DAYS
from ..functions.dates import check_range


def user_cohorts(wide: DataFrame) -> DataFrame:
    """First active date per user: (user_id, cohort_date)."""
    return wide.groupBy("user_id").agg(F.min("date").alias("cohort_date"))


def cohort_sizes(wide: DataFrame) -> DataFrame:
    """Users per cohort date: (cohort_date, cohort_users)."""
    return (user_cohorts(wide).groupBy("cohort_date")
            .agg(F.count("user_id").alias("cohort_users")))


def cohort_matrix(wide: DataFrame, horizon: int = RETENTION_HORIZON_DAYS) -> DataFrame:
    """(cohort_date, day_diff, active_users, cohort_users) for day 0..horizon."""
    active = wide.select("user_id", "date").distinct()
    cells = (active
             .withColumn("cohort_date", F.min("date").over(Window.partitionBy("user_id")))
             .withColumn("day_diff", F.datediff("date", "cohort_date"))
             .filter(F.col("day_diff").between(0, horizon))
             .groupBy("cohort_date", "day_diff")
             .agg(F.count(F.lit(1)).alias("active_users")))
    day0 = F.max(F.when(F.col("day_diff") == 0, F.col("active_users")))
    return cells.withColumn("cohort_users", day0.over(Window.partitionBy("cohort_date")))


def cohorts_in(matrix: DataFrame, start, end) -> DataFrame:
    """Matrix rows whose cohort date lies in the range."""
    lo, hi = check_range(start, end)
    return (matrix.filter(F.col("cohort_date").between(F.lit(lo), F.lit(hi)))
            .select("cohort_date", "day_diff", "active_users", "cohort_users"))


def cohort_read(matrix: DataFrame, start, end) -> DataFrame:
    """Matrix rows whose cohort date lies in the range, ordered."""
    return cohorts_in(matrix, start, end).orderBy("cohort_date", "day_diff")


def retention_pct() -> F.Column:
    """round(active / max(cohort, 1) * 100, 2) as a Column."""
    return F.round(F.col("active_users") / F.greatest(F.col("cohort_users"), F.lit(1)) * 100, 2)


def retention_rates(cohort_rows: DataFrame) -> DataFrame:
    """[day, cohort, %] triples."""
    return cohort_rows.select(
        F.col("day_diff"),
        F.date_format("cohort_date", "yyyy-MM-dd").alias("cohort_date"),
        retention_pct().alias("retention_pct"),
    )


def retention_grid(cohort_rows: DataFrame) -> DataFrame:
    """Grid coordinates: row index = rank of the cohort date (0-based),
    column = day_diff. The matrix has at most (#dates x (horizon+1)) rows,
    so the unpartitioned rank runs on a small input."""
    rank = F.dense_rank().over(Window.orderBy("cohort_date")) - 1
    return cohort_rows.select(
        rank.alias("row_idx"), "cohort_date", "day_diff", retention_pct().alias("retention_pct"))


def retention_wide(cohort_rows: DataFrame, horizon: int = RETENTION_HORIZON_DAYS) -> DataFrame:
    """One row per cohort, one column per day (pivot with known values)."""
    return (cohort_rows.withColumn("retention_pct", retention_pct())
            .groupBy("cohort_date").pivot("day_diff", list(range(horizon + 1)))
            .agg(F.first("retention_pct")))


def last_cohorts(cohort_rows: DataFrame, n: int = LAST_COHORTS) -> DataFrame:
    """Matrix rows of the ``n`` most recent cohort dates."""
    recent = F.dense_rank().over(Window.orderBy(F.col("cohort_date").desc()))
    return cohort_rows.withColumn("_r", recent).filter(F.col("_r") <= n).drop("_r")
