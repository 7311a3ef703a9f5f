"""Behaviour-log profiling: volume per day and per hour, head-item traffic
share, stage counts with conversion rates, and the time-ordered log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import PARETO_HEAD_FRACTION, PROFILE_HOUR_OFFSET, TYPE_BUY, TYPE_CART, TYPE_PV
from ..functions.dates import event_date


def daily_volume(log: DataFrame, tz: str = "UTC") -> DataFrame:
    """Events per calendar date in zone ``tz``."""
    return (log.groupBy(event_date("ts", tz).alias("date"))
            .agg(F.count(F.lit(1)).alias("events")).orderBy("date"))


def hourly_volume(spark: SparkSession, log: DataFrame, offset_hours: int = PROFILE_HOUR_OFFSET) -> DataFrame:
    """Events per hour of day on a fixed clock offset; all 24 hours listed."""
    hour = F.floor(F.pmod(F.col("ts") + offset_hours * 3600, F.lit(86400)) / 3600).cast("int")
    counts = log.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("events"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return (hours.join(F.broadcast(counts), "hour", "left")
            .select("hour", F.coalesce("events", F.lit(0)).alias("events")).orderBy("hour"))


def pareto_share(log: DataFrame, head_fraction: float = PARETO_HEAD_FRACTION) -> DataFrame:
    """Share of all events taken by the ``floor(n * fraction)`` busiest items.

    Exact and without a global sort of items: events per item -> histogram
    (events per item -> number of items with that count). The histogram has
    at most sqrt(2 * events) rows (distinct counts summing to at most the
    event total), so the cumulative window over it stays small while the
    per-item counting is a normal partial aggregation. Ties do not matter:
    the head sum only depends on the count values.
    """
    per_item = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    hist = per_item.groupBy("c").agg(F.count(F.lit(1)).alias("items"))
    totals = hist.select(F.struct(
        F.sum("items").alias("n_items"),
        F.sum(F.col("c") * F.col("items")).alias("total"))).scalar()
    n_items = totals["n_items"]
    head_n = F.floor(n_items * F.lit(head_fraction)).cast("long")
    desc = Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = hist.select("c", "items", F.sum("items").over(desc).alias("cum"))
    prev = F.col("cum") - F.col("items")
    taken = F.greatest(F.least(F.col("items"), head_n - prev), F.lit(0))
    head = levels.agg(F.sum(F.col("c") * taken).alias("head_events"))
    return head.select(
        n_items.alias("n_items"),
        head_n.alias("head_items"),
        F.coalesce(F.col("head_events"), F.lit(0)).cast("long").alias("head_events"),
        totals["total"].alias("total_events"),
        F.round(F.coalesce(F.col("head_events"), F.lit(0)) / F.nullif(totals["total"], F.lit(0)) * 100, 4)
        .alias("head_share_pct"),
    )


def stage_conversion(log: DataFrame) -> DataFrame:
    """Each shop event carries its deepest stage, so pv = all of them, cart =
    cart or buy rows, buy = buy rows; rates guarded by max(n, 1)."""
    c = log.agg(
        F.count_if(F.col("type").isin(TYPE_PV, TYPE_CART, TYPE_BUY)).alias("pv"),
        F.count_if(F.col("type").isin(TYPE_CART, TYPE_BUY)).alias("cart"),
        F.count_if(F.col("type") == TYPE_BUY).alias("buy"),
    )
    def pct(a, b):
        return F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)) * 100, 2)
    return c.select("pv", "cart", "buy",
                    pct("cart", "pv").alias("pv_to_cart_pct"),
                    pct("buy", "cart").alias("cart_to_buy_pct"),
                    pct("buy", "pv").alias("pv_to_buy_pct"))


def events_by_time(log: DataFrame) -> DataFrame:
    """The whole log ordered by time (range-partitioned distributed sort)."""
    return log.orderBy(F.col("ts").asc_nulls_last(), "user_id", "item_id", "type")
