"""Map the supplied TPC-H-style tables onto the shop data model.

The supplied data has no shopping log, so:

* behaviour log  <- every row of ``events`` (view -> pv, click -> cart,
  purchase -> buy; other event types keep their own name, and the operators
  that need shop behaviour filter on the type). The item is taken from the
  user and the number in ``props`` over the whole key range of ``part``: each
  user meets four items, often enough for strict funnels, and the number of
  items grows with the number of users.
* item dimension <- every row of ``part``; keys ending in 9 have no price and
  exercise the missing-price path.
* user dimension <- every row of ``customer``; every eleventh has neither
  channel nor age band; the age band comes from ``c_nationkey``.
* purchase facts at scale <- ``lineitem ⋈ orders ⋈ part ⋈ customer``.

Missing attributes are values set by rule; no row is left out. Each function
has a DuckDB twin in ``martlet.oracle``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import epoch_seconds

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one supplied table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def behavior_log(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """The behaviour log mapped from ``events``, with ``more`` columns of it."""
    ev = table(spark, sf_dir, "events")
    n_items = table(spark, sf_dir, "part").select(F.max("p_partkey") + 1).scalar()
    k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
    item = F.pmod(F.col("user_id") * 13 + k % 4, n_items)
    kind = (F.when(F.col("event_type") == "view", "pv")
            .when(F.col("event_type") == "click", "cart")
            .when(F.col("event_type") == "purchase", "buy")
            .otherwise(F.col("event_type")))
    return ev.select(F.col("user_id").cast("int").alias("user_id"),
                     item.cast("int").alias("item_id"),
                     (item % 25).cast("int").alias("category_id"),
                     kind.alias("type"),
                     epoch_seconds("ts").alias("ts"), *more)


#: Lines by the event's number modulo 50: user, item, category, type, time.
BROKEN_EVERY = 50
BROKEN = {
    0: "{u},{i},{c},{t}", 1: "{u},{i},{c},{t},{s},9", 2: "abc,{i},{c},{t},{s}", 3: "{u},{i},{c},{t},noon",
    4: "{u},,{c},{t},{s}", 5: "{u},{i},{c},,{s}", 6: "99999999999,{i},{c},{t},{s}", 7: '{u},{i},{c},"{t}",{s}',
    8: "{u},{i},,{t},{s}", 9: "{u},{i},x,{t},{s}", 10: "{u},z,{c},{t},", 11: " {u} ,{i},{c}, {t} ,{s}",
    12: '{u},{i},{c},"{t},{s}', 13: ",,,,"}


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviour log as CSV lines (``value``), some of them broken."""
    at = (F.col("event_id") % BROKEN_EVERY).cast("int")
    log = behavior_log(spark, sf_dir, at.alias("_at"))
    columns = dict(u="user_id", i="item_id", c="category_id", t="type", s="ts")

    def filled(pattern: str):
        """The pattern with columns in the places of their letters."""
        parts = re.split(r"\{(\w)\}", pattern)
        return F.concat(*[F.lit(p) if n % 2 == 0 else F.col(columns[p]).cast("string") for n, p in enumerate(parts)])
    line = filled("{u},{i},{c},{t},{s}")
    for number, pattern in BROKEN.items():
        line = F.when(F.col("_at") == number, filled(pattern)).otherwise(line)
    return log.select(line.alias("value"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item dimension mapped from ``part``."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("int").alias("item_id"),
        F.col("p_size").cast("int").alias("category_id"),
        F.when(key % 10 != 9, F.col("p_retailprice")).cast("decimal(10,2)").alias("price"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user dimension mapped from ``customer``."""
    nk, known = F.col("c_nationkey"), F.col("c_custkey") % 11 != 10
    age = (F.when(nk < 6, "18-24").when(nk < 13, "25-34")
           .when(nk < 19, "35-45").when(nk < 24, "46+"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("user_id"),
        F.when(known, age).alias("age_group"),
        F.when(known, F.col("c_mktsegment")).alias("channel"))


def sales_facts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Purchase facts in the ``buy_fact`` shape, or some of its columns.

    Every line has its order, and orders and lines have their customer and
    part, so a side that gives none of the columns asked for is not joined.
    All inputs grow with the scale factor, so no side is hinted: AQE picks
    broadcast for a side that turns out small at run time and keeps the shuffle
    join otherwise.
    """
    made = {
        "date": ("orders", F.to_date("o_orderdate")),
        "user_id": ("orders", F.col("o_custkey").cast("int")),
        "order_id": ("lineitem", F.col("l_orderkey").cast("string")),
        "item_id": ("lineitem", F.col("l_partkey").cast("int")),
        "category_id": ("part", F.col("p_size").cast("int")),
        "price": ("lineitem", F.col("l_extendedprice").cast("decimal(10,2)")),
        "channel": ("orders", F.col("o_orderpriority")),
        "age_group": ("customer", F.col("c_mktsegment")),
    }
    wanted = columns or tuple(made)
    sides = {made[c][0] for c in wanted}
    out = table(spark, sf_dir, "lineitem")
    if sides & {"orders", "customer"}:
        out = out.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in sides:
        out = out.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if "customer" in sides:
        out = out.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return out.select(*[made[c][1].alias(c) for c in wanted])


# Parameters the registered queries use with the fixtures.
LOG_WINDOW = ("2024-01-01", "2024-01-31")
LOG_TZ = "UTC"
SALES_SPAN = ("1995-01-01", "2001-12-31")
SALES_MONTH = ("1998-03-01", "1998-03-31")
