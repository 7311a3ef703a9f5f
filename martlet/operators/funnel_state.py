"""Incremental funnels: mergeable first touches, kept as segments.

First touches are minima, so the touches of any two logs merge by taking minima
per (user, item), in any order, late events included. The state is a folder of
segments, one per update:

* ``touch``: the update's own first touches;
* ``rows``: the funnel rows of every user the update touched, rebuilt from
  those users' touches in all segments;
* ``users``: the users it touched.

An update reads its own log and the stored touches of the users in it; nothing
else is read or rewritten. A reader takes each user's rows from the newest
segment that has the user. Segments become visible by a numbered commit
(``sinks.commits``) that names them; a batch that is named already is not
applied again, so a run that is repeated changes nothing. ``compact`` folds all
segments into one.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FUNNEL_MART
from ..sinks import commits
from ..sinks.publish import delete_path
from . import funnel

TOUCH = "user_id int, item_id int, first_pv long, first_cart long, first_buy long"
USERS = "user_id int"
_MINIMA = ("first_pv", "first_cart", "first_buy")


def merge_touches(*touches: DataFrame) -> DataFrame:
    """First touches of several logs together."""
    return (reduce(DataFrame.unionByName, touches).groupBy("user_id", "item_id")
            .agg(*[F.min(c).alias(c) for c in _MINIMA]))


class FunnelState:
    """The strict or loose funnel of a log that arrives in batches."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "strict", tz: str = "UTC"):
        if kind not in ("strict", "loose"):
            raise ValueError("kind must be 'strict' or 'loose'")
        self.spark, self.root, self.kind, self.tz = spark, root.rstrip("/"), kind, tz

    @property
    def _log(self) -> str:
        return f"{self.root}/_commits"

    def segments(self) -> list[dict]:
        """The visible segments, oldest first: batch names and folder."""
        return commits.newest(self.spark, self._log)[1].get("segments", [])

    def _read(self, segments: list[dict], part: str, schema) -> DataFrame:
        """One part of some segments, each row with its segment's number."""
        empty = self.spark.createDataFrame([], schema).withColumn("_n", F.lit(0))
        each = [self.spark.read.schema(schema).parquet(f"{s['path']}/{part}").withColumn("_n", F.lit(n))
                for n, s in enumerate(segments, 1)]
        return reduce(DataFrame.unionByName, each, empty)

    def _rows(self, touches: DataFrame) -> DataFrame:
        flags = funnel.strict_flags if self.kind == "strict" else funnel.loose_flags
        return funnel.funnel_mart(flags(touches, self.tz))

    def _stage(self, touches: DataFrame, known: list[dict], batch: str) -> dict:
        path = f"{self.root}/segment-{uuid.uuid4().hex[:12]}"
        touches.select("user_id", "item_id", *_MINIMA).write.parquet(f"{path}/touch")
        own = self.spark.read.schema(TOUCH).parquet(f"{path}/touch")
        own.select("user_id").distinct().write.parquet(f"{path}/users")
        users = self.spark.read.schema(USERS).parquet(f"{path}/users")
        before = self._read(known, "touch", TOUCH).drop("_n").join(users, "user_id", "left_semi")
        self._rows(merge_touches(own, before)).write.parquet(f"{path}/rows")
        return {"batches": [batch], "path": path}

    def update(self, wide: DataFrame, batch: str) -> bool:
        """Merge the cleaned rows of a batch; False if it is in the state.

        If another writer commits in between, users of both batches have rows
        without the other's touches, so the batch is staged again on top of it.
        """
        touches = funnel.first_touch(wide)
        while True:
            number, state = commits.newest(self.spark, self._log)
            known = state.get("segments", [])
            if any(batch in s["batches"] for s in known):
                return False
            made = self._stage(touches, known, batch)
            if commits.create(self.spark, self._log, number + 1, {"segments": [*known, made]}):
                return True
            delete_path(self.spark, made["path"])

    def mart(self) -> DataFrame:
        """The funnel mart: every user's rows from the newest segment with it."""
        segments = self.segments()
        latest = self._read(segments, "users", USERS).groupBy("user_id").agg(F.max("_n").alias("_n"))
        return self._read(segments, "rows", FUNNEL_MART).join(latest, ["user_id", "_n"]).drop("_n")

    def touches(self) -> DataFrame:
        """The merged first touches of all segments."""
        return merge_touches(self._read(self.segments(), "touch", TOUCH).drop("_n"))

    def compact(self) -> bool:
        """Fold all segments into one of the same content; False if another
        writer was first. Their batches stay known."""
        number, state = commits.newest(self.spark, self._log)
        known = state.get("segments", [])
        if len(known) < 2:
            return True
        path = f"{self.root}/segment-{uuid.uuid4().hex[:12]}"
        self.touches().write.parquet(f"{path}/touch")
        self._read(known, "users", USERS).select("user_id").distinct().write.parquet(f"{path}/users")
        self.mart().write.parquet(f"{path}/rows")
        made = {"batches": [b for s in known for b in s["batches"]], "path": path}
        return commits.create(self.spark, self._log, number + 1, {"segments": [made]})
