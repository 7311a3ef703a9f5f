"""Load-and-clean: event dates, business window, order key, dimension joins,
missing-price drop, attribute defaults, and the rejected rows.

Joins carry no hint: Spark broadcasts a dimension only below its byte
threshold, and AQE re-plans from measured sizes or splits a hot ``user_id`` of
a shuffle join into several tasks. A left join followed by the null-price drop
is rewritten by Catalyst into an inner join.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import UNKNOWN_AGE_GROUP, UNKNOWN_CHANNEL
from ..functions.dates import event_date, parse_date


def window_epoch_bounds(start, end, tz: str = "UTC") -> tuple:
    """[lo, hi) epoch seconds covering local dates start..end in zone ``tz``."""
    zone = ZoneInfo(tz)
    lo = _dt.datetime.combine(parse_date(start), _dt.time(), zone)
    hi = _dt.datetime.combine(parse_date(end) + _dt.timedelta(days=1), _dt.time(), zone)
    return int(lo.timestamp()), int(hi.timestamp())


def derive_events(log: DataFrame, window: tuple | None = None, tz: str = "UTC") -> DataFrame:
    """Add ``date`` (in zone ``tz``), keep the inclusive business window,
    add ``order_id = user_id_ts_item_id``.

    The window is applied twice, equivalently: as a range on the raw ``ts``
    column, which Catalyst pushes into the file scan (row-group skipping on a
    time-ordered log), and as the exact date predicate.
    """
    out = log
    if window is not None:
        lo, hi = window_epoch_bounds(window[0], window[1], tz)
        out = out.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    out = out.withColumn("date", event_date("ts", tz))
    if window is not None:
        start, end = parse_date(window[0]), parse_date(window[1])
        out = out.filter(F.col("date").between(F.lit(start), F.lit(end)))
    return out.withColumn("order_id", F.concat_ws("_", "user_id", "ts", "item_id"))


def join_dimensions(events: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Events ⟕ items (without their category) ⟕ users."""
    return (events.join(items.drop("category_id"), "item_id", "left")
            .join(users, "user_id", "left"))


def priced_events(events: DataFrame, items: DataFrame) -> DataFrame:
    """Events with a price, without user attributes: what RFM needs. Without
    the users join the only exchange on ``user_id`` carries partial
    aggregates, so a hot buyer is spread over tasks."""
    return events.join(items.select("item_id", "price").where("price IS NOT NULL"), "item_id")


def malformed_events(log: DataFrame) -> DataFrame:
    """Log rows without a user, item, type or time (fields that did not parse
    become NULL): their order keys are not unique."""
    return log.where("user_id IS NULL OR item_id IS NULL OR type IS NULL OR ts IS NULL")


def clean_wide(joined: DataFrame) -> DataFrame:
    """Drop rows without a price, fill missing channel / age band."""
    return (joined.dropna(subset=["price"])
            .fillna({"channel": UNKNOWN_CHANNEL, "age_group": UNKNOWN_AGE_GROUP}))


def rejected_events(joined: DataFrame) -> DataFrame:
    """Rows the clean step drops (no price): the dead-letter set."""
    return joined.filter(F.col("price").isNull())


@dataclass
class Cleaned:
    raw: DataFrame      # log as read
    events: DataFrame   # dated, windowed, keyed
    joined: DataFrame   # events ⟕ items ⟕ users
    wide: DataFrame     # cleaned wide table
    priced: DataFrame   # events with a price, no user attributes


def load_and_clean(log: DataFrame, items: DataFrame, users: DataFrame,
                   window: tuple | None = None, tz: str = "UTC") -> Cleaned:
    """Dated, windowed, keyed events joined to the dimensions and cleaned."""
    events = derive_events(log, window, tz)
    joined = join_dimensions(events, items, users)
    return Cleaned(raw=log, events=events, joined=joined, wide=clean_wide(joined),
                   priced=priced_events(events, items))
