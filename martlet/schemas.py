"""Declared schemas: one StructType per table, no inference passes."""

from pyspark.sql.types import (BinaryType, DateType, DecimalType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType,
                               TimestampType)

MONEY = DecimalType(10, 2)

# Behaviour log: headerless CSV, ``ts`` in epoch seconds (widened to long).
BEHAVIOR = StructType([
    StructField("user_id", IntegerType()),
    StructField("item_id", IntegerType()),
    StructField("category_id", IntegerType()),
    StructField("type", StringType()),
    StructField("ts", LongType()),
])

ITEMS = StructType([
    StructField("item_id", IntegerType()),
    StructField("category_id", IntegerType()),
    StructField("price", MONEY),
])

USERS = StructType([
    StructField("user_id", IntegerType()),
    StructField("age_group", StringType()),
    StructField("channel", StringType()),
])

BUY_FACT = StructType([
    StructField("date", DateType()),
    StructField("user_id", IntegerType()),
    StructField("order_id", StringType()),
    StructField("item_id", IntegerType()),
    StructField("category_id", IntegerType()),
    StructField("price", MONEY),
    StructField("channel", StringType()),
    StructField("age_group", StringType()),
])

USER_RFM = StructType([
    StructField("user_id", IntegerType()),
    StructField("rfm_label", StringType()),
])

COHORT_MATRIX = StructType([
    StructField("cohort_date", DateType()),
    StructField("day_diff", IntegerType()),
    StructField("active_users", LongType()),
    StructField("cohort_users", LongType()),
])

FUNNEL_MART = StructType([
    StructField("user_id", IntegerType()),
    StructField("date", DateType()),
    StructField("has_pv", IntegerType()),
    StructField("has_cart", IntegerType()),
    StructField("has_buy", IntegerType()),
])

# Pre-aggregated marts the dashboard is served from.
SALES_CELLS = StructType([
    StructField("date", DateType()),
    StructField("item_id", IntegerType()),
    StructField("category_id", IntegerType()),
    StructField("channel", StringType()),
    StructField("age_group", StringType()),
    StructField("sales", DecimalType(20, 2)),
    StructField("n_rows", LongType()),
])

DAY_ORDERS = StructType([
    StructField("date", DateType()),
    StructField("bucket", LongType()),
    StructField("sales", DecimalType(30, 2)),
    StructField("members", BinaryType()),
])

DAY_BUYERS = StructType([StructField("rfm_label", StringType()), *DAY_ORDERS.fields])

# Log rows that did not parse, as they were.
DEAD_LETTERS = StructType([StructField("line", StringType()), StructField("reason", StringType())])

DQ_LOG = StructType([
    StructField("run_time", TimestampType()),
    StructField("elapsed_seconds", DoubleType()),
    StructField("metrics", StringType()),
    StructField("warnings", StringType()),
    StructField("cluster_profiles", StringType()),
])

# Sort / partition layout per mart (replaces database sort keys and indexes).
MART_LAYOUT = {
    "buy_fact": {"partition_by": ["date"], "sort_by": ["user_id", "order_id"]},
    "user_rfm": {"partition_by": [], "sort_by": ["user_id"]},
    "cohort_matrix": {"partition_by": [], "sort_by": ["cohort_date", "day_diff"]},
    "user_funnel_mart": {"partition_by": ["date"], "sort_by": ["user_id"]},
    "user_funnel_loose_mart": {"partition_by": ["date"], "sort_by": ["user_id"]},
    "rejected_events": {"partition_by": ["date"], "sort_by": ["user_id", "ts"]},
    "dead_letters": {"partition_by": [], "sort_by": ["reason"]},
    # small beside the facts: no date folders, files of contiguous dates
    "sales_cells": {"partition_by": [], "sort_by": ["date", "item_id"], "range": True},
    "day_orders": {"partition_by": [], "sort_by": ["date", "bucket"], "range": True},
    "day_buyers": {"partition_by": [], "sort_by": ["date", "rfm_label", "bucket"], "range": True},
}


# Declared read schemas of the published marts.
MART_SCHEMAS = {
    "buy_fact": BUY_FACT,
    "user_rfm": USER_RFM,
    "cohort_matrix": COHORT_MATRIX,
    "user_funnel_mart": FUNNEL_MART,
    "user_funnel_loose_mart": FUNNEL_MART,
    "dead_letters": DEAD_LETTERS,
    "sales_cells": SALES_CELLS,
    "day_orders": DAY_ORDERS,
    "day_buyers": DAY_BUYERS,
}
