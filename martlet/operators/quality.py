"""Data-quality metrics, warnings and the per-run log row.

All metrics are DataFrames computed by Spark. A metric is an aggregate
expression over a source (``Metric``); ``fused`` groups metrics by source plan
and takes all of one source in one pass.

``dq_metrics`` goes further: the joined table is not built to count its rows.
Each dimension is reduced to one row per key with its number of rows and of
rows without an attribute; an event then stands for as many joined rows as the
product of both, so all counters of the log and of the join are sums over one
pass of the log, and duplicate keys multiply as they do in the join.

The batch pipeline (``plans.etl.run_etl``) gathers the same counters without
extra passes: ``observe`` on the single materialising pass and on every mart
write.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import TYPE_BUY
from ..functions.dates import event_date, parse_date
from .dead_letters import REQUIRED


def data_cutoff(events: DataFrame) -> DataFrame:
    """Last event date of the windowed log."""
    return events.agg(F.max("date").alias("cutoff_date"))


@dataclass
class Metric:
    """A named aggregate over a source."""
    name: str
    source: DataFrame
    value: Column


def fused(metrics: list[Metric], name: str = "metric", value: str = "value") -> DataFrame:
    """Long (name, value) table: one aggregate per distinct source plan."""
    groups: list[tuple[DataFrame, list[Metric]]] = []
    for m in metrics:
        for source, own in groups:
            if source is m.source or source.sameSemantics(m.source):
                own.append(m)
                break
        else:
            groups.append((m.source, [m]))

    def rows(source: DataFrame, own: list[Metric]) -> DataFrame:
        one = source.agg(*[m.value.alias(f"_{i}") for i, m in enumerate(own)])
        return one.select(F.inline(F.array(*[F.struct(F.lit(m.name).alias(name), F.col(f"_{i}").alias(value))
                                             for i, m in enumerate(own)])))
    return reduce(DataFrame.unionByName, [rows(*g) for g in groups])


def dq_counts(tables: dict) -> DataFrame:
    """(table_name, rows) for each named DataFrame, or (DataFrame, condition)
    for its rows that meet one; tables over one source share its pass."""
    metrics = []
    for name, t in tables.items():
        source, condition = t if isinstance(t, tuple) else (t, None)
        metrics.append(Metric(name, source, F.count(F.lit(1)) if condition is None else F.count_if(condition)))
    return fused(metrics, "table_name", "rows")


def dq_nulls(joined: DataFrame) -> DataFrame:
    """Missing price / channel / age band, counted before the price drop."""
    return joined.agg(
        F.count_if(F.col("price").isNull()).alias("missing_price"),
        F.count_if(F.col("channel").isNull()).alias("missing_channel"),
        F.count_if(F.col("age_group").isNull()).alias("missing_age_group"),
    )


def dq_drop_rate(raw: DataFrame, wide: DataFrame) -> DataFrame:
    """(1 - clean / max(raw, 1)) * 100, rounded to 2 decimals; includes rows
    lost to the date window, and can go negative when a dimension has
    duplicate keys (the join multiplies rows)."""
    raw_n = raw.select(F.count(F.lit(1))).scalar()
    return wide.agg(F.count(F.lit(1)).alias("clean_rows")).select(
        raw_n.alias("raw_rows"), "clean_rows",
        F.round((1 - F.col("clean_rows") / F.greatest(raw_n, F.lit(1))) * 100, 2).alias("drop_rate_pct"),
    )


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once in a dimension (they multiply rows)."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def _per_key(dim: DataFrame, key: str, *attributes: str) -> DataFrame:
    """One row per key: its rows, and those that lack each attribute."""
    return dim.groupBy(F.col(key).alias(f"_{key}")).agg(
        F.count("*").alias(f"_{key}_rows"),
        *[F.count_if(F.col(a).isNull()).alias(f"_no_{a}") for a in attributes])


def dq_metrics(log: DataFrame, items: DataFrame, users: DataFrame, window: tuple | None = None, tz: str = "UTC",
               marts: bool = False) -> DataFrame:
    """Long (metric, value) table of a log and its dimensions: raw, malformed
    and clean rows, missing attributes after the joins, keys that occur more
    than once, and with ``marts`` the purchase facts. Each input is read once:
    the dimensions' own metrics come from the same per-key rows that the log is
    joined to."""
    item, user = _per_key(items, "item_id", "price"), _per_key(users, "user_id", "channel", "age_group")
    inside = F.lit(True)
    if window is not None:
        inside = event_date("ts", tz).between(F.lit(parse_date(window[0])), F.lit(parse_date(window[1])))
    joined = (log.withColumn("_inside", F.coalesce(inside, F.lit(False)))
              .join(item, F.col("item_id") == F.col("_item_id"), "left")
              .join(user, F.col("user_id") == F.col("_user_id"), "left"))
    # a key that is not in the dimension is one joined row without attributes
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    priced = n("_item_id_rows") - n("_no_price")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("_inside"), c)), F.lit(0)).cast("double")
    count = lambda c: F.count_if(c).cast("double")
    absent = reduce(Column.__or__, [F.col(c).isNull() for c in REQUIRED])
    metrics = [
        Metric("raw_rows", joined, F.count("*").cast("double")),
        Metric("malformed_rows", joined, count(absent)),
        Metric("missing_price", joined, total(n("_no_price") * n("_user_id_rows"))),
        Metric("missing_channel", joined, total(n("_item_id_rows") * n("_no_channel"))),
        Metric("missing_age_group", joined, total(n("_item_id_rows") * n("_no_age_group"))),
        Metric("clean_rows", joined, total(priced * n("_user_id_rows"))),
        Metric("drop_rate_pct", joined, F.round(
            (1 - total(priced * n("_user_id_rows")) / F.greatest(F.count("*"), F.lit(1))) * 100, 2)),
        Metric("item_rows", item, F.coalesce(F.sum("_item_id_rows"), F.lit(0)).cast("double")),
        Metric("unpriced_items", item, F.coalesce(F.sum("_no_price"), F.lit(0)).cast("double")),
        Metric("duplicate_item_keys", item, count((F.col("_item_id_rows") > 1))),
        Metric("user_rows", user, F.coalesce(F.sum("_user_id_rows"), F.lit(0)).cast("double")),
        Metric("users_without_channel", user, F.coalesce(F.sum("_no_channel"), F.lit(0)).cast("double")),
        Metric("users_without_age_group", user, F.coalesce(F.sum("_no_age_group"), F.lit(0)).cast("double")),
        Metric("duplicate_user_keys", user, count(F.col("_user_id_rows") > 1)),
    ]
    if marts:
        metrics.append(Metric("buy_fact_rows", joined, total(
            F.when(F.col("type") == TYPE_BUY, priced * n("_user_id_rows")))))
    return fused(metrics)


_WARNINGS = (
    ("missing_price", "{n} rows without price were dropped; they are kept in the rejects table"),
    ("missing_channel", "{n} rows without channel were filled with the unknown-channel text"),
    ("missing_age_group", "{n} rows without age band were filled with the unknown-age text"),
)


def dq_warnings(nulls: DataFrame) -> DataFrame:
    """One row per counter above zero: (metric, n, message)."""
    entries = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("n"),
                        F.replace(F.lit(tmpl), F.lit("{n}"), F.col(m).cast("string")).alias("message"))
               for m, tmpl in _WARNINGS]
    return nulls.select(F.inline(F.array(*entries))).filter(F.col("n") > 0)


def dq_log_row(metrics: DataFrame, warnings: DataFrame, profiles: DataFrame | None,
               run_time: _dt.datetime, elapsed_seconds: float) -> DataFrame:
    """One log row with JSON text columns. Metric, warning and profile lists
    are bounded (a fixed metric set, three warning kinds, k <= 5 clusters).

    ``metrics`` is either the long (metric, value) table or one wide row of
    typed metrics (numbers and text such as the cut-off date side by side).
    """
    if set(metrics.columns) == {"metric", "value"}:
        m = metrics.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("metric", "value"))))
                        .alias("metrics"))
    else:
        m = metrics.select(F.to_json(F.struct(*metrics.columns)).alias("metrics"))
    w = warnings.agg(F.to_json(F.collect_list("message")).alias("warnings")).scalar()
    if profiles is not None:
        p = profiles.agg(F.to_json(F.collect_list(F.struct(*profiles.columns))).alias("p")).scalar()
    else:
        p = F.lit("[]")
    return m.select(
        F.lit(run_time).cast("timestamp").alias("run_time"),
        F.lit(float(elapsed_seconds)).alias("elapsed_seconds"),
        "metrics",
        F.coalesce(w, F.lit("[]")).alias("warnings"),
        F.coalesce(p, F.lit("[]")).alias("cluster_profiles"),
    )
