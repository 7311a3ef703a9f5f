"""Pre-aggregated marts that the dashboard is served from.

* ``sales_cells``: the additive cube, sales per (date, item, category, channel,
  age band).
* ``member_sets``: exact, mergeable sets of distinct members (orders, buyers)
  as bitmaps. Members get dense numbers; a set is one row per bucket of
  32,768 numbers, with a bitmap of 4 KB and the sales of those members. Sets of
  days merge into weeks, months or any range by a bitwise OR, and the size of
  the result is the exact distinct count, without the facts.

Numbers follow the members' first dates, so a day's members lie in few buckets
and sets of days overlap little. They are dealt out without a global order in
one task: members are range-partitioned, numbered inside their partitions, and
each partition starts after the members of those before it. The placed members
are written once first, because the place decides the number.

A set costs 4 KB per bucket it touches, so sets are kept per date, or per date
and a few-valued attribute; at item level a cell has hardly more members than
rows and the facts themselves are the smaller form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORY_PREFIX, ITEM_PREFIX, TOP_K
from ..functions.dates import comparison_windows, key_label, period_key
from ..session import scratch_path
from .sales import between, growth_row, in_range, money

CELL = ["date", "item_id", "category_id", "channel", "age_group"]
_PLACE = 33            # bits of the place inside a partition in a monotonic id


def sales_cells(facts: DataFrame) -> DataFrame:
    """(date, item_id, category_id, channel, age_group, sales, n_rows)."""
    return facts.groupBy(*CELL).agg(F.sum("price").alias("sales"), F.count("*").alias("n_rows"))


def dense_numbers(facts: DataFrame, member: str, after: int = 0) -> DataFrame:
    """(member, number): every distinct non-NULL member once, numbered
    ``after + 1 ..`` without gaps in the order of first date and member."""
    spark = facts.sparkSession
    first = (facts.where(F.col(member).isNotNull()).groupBy(member).agg(F.min("date").alias("_first"))
             .repartitionByRange("_first", member).sortWithinPartitions("_first", member)
             .select(member, F.monotonically_increasing_id().alias("_id")))
    path = scratch_path(spark, f"numbers-{member}")
    first.write.parquet(path)
    placed = (spark.read.schema(first.schema).parquet(path)
              .select(member, F.shiftright("_id", _PLACE).alias("_part"), F.expr(f"_id & {(1 << _PLACE) - 1}").alias("_at")))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return placed.join(starts, "_part").select(member, (F.col("_before") + F.col("_at") + 1 + after).alias("number"))


def member_sets(facts: DataFrame, numbers: DataFrame, member: str, *by: str) -> DataFrame:
    """(date, *by, bucket, sales, members): per day (and ``by``) the bitmap of
    members in each bucket and their sales. Rows without a member have a NULL
    bucket, an empty set and their sales."""
    each = facts.groupBy("date", *by, member).agg(F.sum("price").alias("sales"))
    return (each.join(numbers, member, "left")
            .groupBy("date", *by, F.bitmap_bucket_number("number").alias("bucket"))
            .agg(F.sum("sales").alias("sales"),
                 F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("members")))


def merged(sets: DataFrame, by: str) -> DataFrame:
    """Sets OR-ed over everything but ``by``: (by, sales, members_count)."""
    return (sets.groupBy(by, "bucket").agg(F.expr("sum(sales) AS sales"), F.expr("bitmap_or_agg(members) AS members"))
            .groupBy(by).agg(F.expr("sum(sales) AS sales"), F.expr("sum(bitmap_count(members)) AS members_count")))


def set_buckets(sets: DataFrame, start, end, period: str = "day") -> DataFrame:
    """Sales and distinct members per period bucket, in no order."""
    return merged(in_range(sets, start, end).withColumn("_k", period_key("date", period)), "_k")


def set_trend(sets: DataFrame, start, end, period: str = "day") -> DataFrame:
    """The trend (dt, sales, orders) from daily order sets, in order."""
    return (set_buckets(sets, start, end, period).orderBy("_k")
            .select(key_label("_k", period).alias("dt"), money(F.col("sales")).alias("sales"),
                    F.col("members_count").alias("orders")))


def set_core(sets: DataFrame, start, end) -> DataFrame:
    """Total sales and distinct orders of a range from daily order sets."""
    return (in_range(sets, start, end).groupBy("bucket")
            .agg(F.sum("sales").alias("sales"), F.bitmap_or_agg("members").alias("members"))
            .agg(F.coalesce(money(F.sum("sales")), F.lit(0.0)).alias("total_sales"),
                 F.coalesce(F.sum(F.bitmap_count("members")), F.lit(0)).alias("total_orders")))


def set_growth(sets: DataFrame, start, end, period: str = "day") -> DataFrame:
    """``sales.growth`` from daily order sets: three windows, one pass."""
    w = comparison_windows(start, end, period)
    cur, prev, ly = (between(*w[k]) for k in ("current", "previous", "last_year"))
    sales = F.col("sales")
    buckets = sets.where(cur | prev | ly).groupBy("bucket").agg(
        F.sum(F.when(cur, sales)).alias("_cur"), F.sum(F.when(prev, sales)).alias("_prev"),
        F.sum(F.when(ly, sales)).alias("_ly"), F.bitmap_or_agg(F.when(cur, F.col("members"))).alias("_members"))
    return growth_row(buckets.agg(*map(F.expr, (
        "sum(_cur) AS _cur", "sum(_prev) AS _prev", "sum(_ly) AS _ly",
        "coalesce(sum(bitmap_count(_members)), 0) AS total_orders"))), w, period)


def set_distribution(buyers: DataFrame, start, end, by: str = "rfm_label") -> DataFrame:
    """Distinct buyers in the range per segment label, from daily buyer sets."""
    return (merged(in_range(buyers, start, end), by).where("members_count > 0")
            .select(by, F.col("members_count").alias("cnt")))


def ranked_slices(cells: DataFrame, start, end, top_k: int = TOP_K) -> DataFrame:
    """(section, name, value): top items, top categories, every channel and
    age band, from one scan and one aggregation of the cube.

    Channels and age bands are window partitions of their own, so one limited
    row number serves all four: each task cuts items and categories to the top
    k before anything is shuffled by kind.
    """
    sets = [["item_id"], ["category_id"], ["channel"], ["age_group"]]
    # grouping_id has a bit per grouping column, set where it is rolled up
    item, category, channel, age = (0b0111, 0b1011, 0b1101, 0b1110)
    grouped = (in_range(cells, start, end).groupingSets(sets, "item_id", "category_id", "channel", "age_group")
               .agg(F.expr("CAST(grouping_id() AS INT) AS _kind"), F.expr("sum(sales) AS _sales")))
    rows = grouped.selectExpr(
        "_kind", "_sales", f"CASE _kind WHEN {item} THEN item_id WHEN {category} THEN category_id END AS _id",
        f"CASE _kind WHEN {channel} THEN channel WHEN {age} THEN age_group END AS _text")
    top = rows.withColumn("_rank", F.expr(
        "row_number() OVER (PARTITION BY _kind, _text ORDER BY _sales DESC, _id ASC NULLS LAST)")).where(f"_rank <= {top_k}")
    return top.selectExpr(
        f"CASE _kind WHEN {item} THEN 'rankings' WHEN {category} THEN 'category' WHEN {channel} THEN 'channel' "
        "ELSE 'age_group' END AS section",
        f"CASE _kind WHEN {item} THEN concat('{ITEM_PREFIX}', CAST(_id AS STRING)) "
        f"WHEN {category} THEN concat('{CATEGORY_PREFIX}', CAST(_id AS STRING)) ELSE _text END AS name",
        "CAST(_sales AS DOUBLE) AS value")
