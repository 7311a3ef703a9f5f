"""Batch pipeline: log + dimensions -> cleaned wide table -> marts -> publish.

One pass builds and persists the joined table (events ⟕ items ⟕ users);
the data-quality counters (rows, null price/channel/age, last date) ride
along on that same pass through ``observe`` instead of extra scans. The
cleaned wide table and the rejected rows are filters over that cache, and
every mart reads it. Persisted blocks lost with an executor are recomputed
from lineage (scan + joins), so a run survives executor loss; the marts are
written to shared storage and switched together by one pointer commit.
"""

from __future__ import annotations

import datetime as _dt
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import clean, cohort, dead_letters, facts, funnel, quality, rfm
from ..sinks import publish as sink
from .dashboard import cube_marts


@dataclass
class Marts:
    joined: DataFrame
    wide: DataFrame
    buy_fact: DataFrame
    user_funnel_mart: DataFrame
    user_funnel_loose_mart: DataFrame
    cohort_matrix: DataFrame
    rejected: DataFrame
    segments: rfm.Segments | None = None
    touch: DataFrame | None = None

    def release(self) -> None:
        for df in (self.touch, self.joined):
            if df is not None:
                df.unpersist()

    def tables(self) -> dict:
        out = {
            "buy_fact": self.buy_fact,
            "cohort_matrix": self.cohort_matrix,
            "user_funnel_mart": self.user_funnel_mart,
            "user_funnel_loose_mart": self.user_funnel_loose_mart,
            "rejected_events": self.rejected,
        }
        if self.segments is not None:
            out["user_rfm"] = self.segments.user_rfm
        return out


def build_marts(log: DataFrame, items: DataFrame, users: DataFrame, window=None,
                tz: str = "UTC", cutoff=None,
                segment: bool = True, thresholds=None, weights=None,
                observation: Observation | None = None,
                materialize: str = "persist", work_path: str | None = None) -> Marts:
    """Lazily define every mart over one materialised joined table.

    ``materialize="persist"`` keeps the joined table in executor memory/disk
    (lost blocks are recomputed from lineage). ``materialize="table"`` writes
    it once to ``work_path`` on shared storage and reads it back: the lineage
    is cut at a durable table, executor loss never re-runs the joins, and
    every mart reads only its columns (Parquet pruning). It is written as is,
    one file per task and no shuffle: every mart reads the whole window, so
    date folders would only multiply files (tasks x days on an unordered
    log). The table write is an action; the counters fill during it.
    Counters sit above the window filter, so its ``ts`` range reaches the scan.
    ``cutoff`` (RFM reference date) defaults to the last windowed event date.
    """
    events = clean.derive_events(log, window, tz)
    joined = clean.join_dimensions(events, items, users)
    if observation is not None:
        joined = joined.observe(
            observation,
            F.count(F.lit(1)).alias("joined_rows"),
            F.count_if(F.col("price").isNull()).alias("missing_price"),
            F.count_if(F.col("channel").isNull()).alias("missing_channel"),
            F.count_if(F.col("age_group").isNull()).alias("missing_age_group"),
            F.max("date").alias("cutoff_date"))
    if materialize == "table":
        if not work_path:
            raise ValueError("materialize='table' needs a work_path on shared storage")
        joined.write.mode("errorifexists").parquet(work_path)
        joined = joined.sparkSession.read.schema(joined.schema).parquet(work_path)
    elif materialize == "persist":
        joined = joined.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        raise ValueError("materialize must be 'persist' or 'table'")
    wide = clean.clean_wide(joined)
    # Both funnels read the same first-touch aggregate; keep it once instead
    # of running that shuffle twice (the marts are staged concurrently).
    touch = funnel.first_touch(wide).persist(StorageLevel.MEMORY_AND_DISK)
    strict = funnel.funnel_mart(funnel.strict_flags(touch, tz))
    loose = funnel.funnel_mart(funnel.loose_flags(touch, tz))
    seg = None
    if segment:
        cut = cutoff if cutoff is not None else rfm.cutoff_value(events)
        seg = rfm.segment_users(rfm.rfm_base(wide, cut), thresholds=thresholds, weights=weights)
    return Marts(joined=joined, wide=wide, buy_fact=facts.buy_fact(wide),
                 user_funnel_mart=strict, user_funnel_loose_mart=loose,
                 cohort_matrix=cohort.cohort_matrix(wide),
                 rejected=clean.rejected_events(joined), segments=seg, touch=touch)


def run_etl(spark: SparkSession, log: DataFrame, items: DataFrame, users: DataFrame,
            out_root: str, window=None, tz: str = "UTC",
            model_path: str | None = None, thresholds=None, weights=None,
            parallelism: int = 4, materialize: str = "table") -> dict:
    """Build, publish (all marts switch together) and append one DQ log row.

    By default the joined table is written once under ``out_root/_work/``
    (shared storage) and every mart reads it back column-pruned; the copy is
    deleted at the end. ``materialize="persist"`` caches it in executors instead.

    Order of work: one pass fills the joined table and the DQ counters; the
    log-derived marts are then staged concurrently while KMeans fits; the
    segment table and the cube marts (``plans.dashboard.cube_marts``) join the
    same version; one pointer commit publishes all.
    ``log`` is a typed log, or one read line by line with a ``reason`` column
    (``files.read_behavior_lines``). Rows that did not parse, or lack a column
    their order key needs, do not reach any other mart: they are published as
    ``dead_letters``. Of a text log, lines and rejects are counted in the one
    pass; it is read again only if there are rejects to write.

    If anything fails, staging stops, its folders and the work table go, caches
    are released, and the error is raised.
    """
    started = time.time()
    out_root = out_root.rstrip("/")
    obs, lines = Observation("dq"), None
    if "reason" in log.columns:
        lines = Observation("lines")
        bad = dead_letters.rejected_lines(log)
        rows_in = dead_letters.clean_rows(log.observe(
            lines, F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("reason").isNotNull()).alias("rejects")))
    else:
        bad, rows_in = dead_letters.set_aside(log), dead_letters.well_formed(log)
    work = f"{out_root}/_work/joined-{sink.new_version()}"
    marts = stager = None
    try:
        marts = build_marts(rows_in, items, users, window, tz, segment=False,
                            observation=obs, materialize=materialize, work_path=work)
        if materialize == "persist":
            marts.joined.count()               # the one pass: fills the cache and the counters
        dq = obs.get
        cutoff = dq["cutoff_date"]
        if cutoff is None:
            raise ValueError("no behaviour events inside the business window")
        # Fill the shared first-touch cache once; the concurrently staged strict
        # and loose marts then both read it instead of racing to compute it.
        marts.touch.count()
        stager = sink.Stager(spark, out_root, parallelism=parallelism)
        if lines is not None and not lines.get["rejects"]:
            bad = spark.createDataFrame([], schemas.DEAD_LETTERS)
        for name, df in (marts.tables() | {"dead_letters": bad}).items():
            stager.stage(name, df)
        marts.segments = rfm.segment_users(rfm.rfm_base(marts.wide, cutoff),
                                           thresholds=thresholds, weights=weights)
        stager.stage("user_rfm", marts.segments.user_rfm)
        for name, df in cube_marts(marts.buy_fact, marts.segments.user_rfm).items():
            stager.stage(name, df)
        if model_path:
            rfm.save_models(marts.segments, model_path)
        profiles = rfm.cluster_profiles(marts.segments)
        rows = stager.commit()
        stager = None

        clean_rows = dq["joined_rows"] - dq["missing_price"]
        # a whole typed log is counted from its file footers
        raw_rows = log.count() if lines is None else lines.get["raw_rows"]
        values = {
            "raw_rows": raw_rows, "item_rows": items.count(), "user_rows": users.count(),
            "malformed_rows": rows["dead_letters"],
            "missing_price": dq["missing_price"], "missing_channel": dq["missing_channel"],
            "missing_age_group": dq["missing_age_group"], "clean_rows": clean_rows,
            "drop_rate_pct": round((1 - clean_rows / max(raw_rows, 1)) * 100, 2),
            **{f"{n}_rows": r for n, r in rows.items()},
            "kmeans_best_k": marts.segments.best_k, "kmeans_silhouette": marts.segments.best_score,
        }
        typed = {**values, "cutoff_date": str(cutoff)}
        metrics = spark.createDataFrame([tuple(typed.values())], list(typed.keys()))
        nulls = spark.createDataFrame([(dq["missing_price"], dq["missing_channel"], dq["missing_age_group"])],
                                      "missing_price long, missing_channel long, missing_age_group long")
        row = quality.dq_log_row(metrics, quality.dq_warnings(nulls), profiles,
                                 _dt.datetime.now(), time.time() - started)
        sink.append_log(row, f"{out_root}/etl_dq_log")
        version = marts_version(spark, out_root)
        return {"version": version, "cutoff_date": str(cutoff), **values,
                "elapsed_seconds": time.time() - started}
    finally:
        if stager is not None:
            stager.abort()
        if marts is not None:
            marts.release()
        if materialize == "table":
            sink.delete_path(spark, work)


def marts_version(spark: SparkSession, out_root: str) -> str:
    """Version of the newest published buy facts."""
    return sink.current_versions(spark, out_root)["buy_fact"]["version"]
