"""Publishing marts: stage every table, then switch them together.

Layout under ``root``::

    root/<table>/v=<version>/...       immutable staged data (Parquet)
    root/_commits/commit-<n>.json      which version of each table is current

``publish`` writes each table into a fresh version folder (partitioned and
sorted per ``MART_LAYOUT``), and only after every table is written creates one
commit (``sinks.commits``) that carries the pointers of all tables, the new
ones and those it leaves alone. Commits are numbered and created only if
absent, so clocks do not decide which is newer, and of two writers at once
neither loses its tables. Readers resolve all names from the newest commit: one
small file, read without a Spark job. They see either the old set of marts or
the new one, never a half-written table or a mixture. ``expire`` deletes
versions no longer pointed at.

Tables are staged concurrently (independent Spark jobs from a thread pool),
and each table's row count is gathered with ``observe`` while it is written,
so no second pass is needed to report sizes.
"""

from __future__ import annotations

import datetime as _dt
import hashlib
import uuid
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import MART_LAYOUT, MART_SCHEMAS
from . import commits


# Layout for long histories of small days: no date folders; rows are range-
# clustered and sorted by date, so each file covers a contiguous date span and
# Parquet min/max statistics skip files and row groups on a date range.
CLUSTERED_BY_DATE = {"partition_by": [], "sort_by": ["date", "user_id", "order_id"], "range": True}


def _layout(name: str, override: dict | None = None) -> dict:
    if override and name in override:
        return override[name]
    return MART_LAYOUT.get(name, {"partition_by": [], "sort_by": []})


def write_table(df: DataFrame, path: str, name: str, mode: str = "errorifexists",
                layout: dict | None = None) -> int:
    """Write one table with its layout; returns the number of rows written.

    ``mode="overwrite"`` gives the plain replace-in-place fallback.
    """
    layout = layout or _layout(name)
    obs = Observation(f"rows_{name}_{uuid.uuid4().hex[:6]}")
    out = df
    if layout.get("range"):
        # Range-cluster on the sort keys (files cover contiguous key spans).
        out = out.repartitionByRange(*layout["partition_by"], *layout["sort_by"])
    elif layout["partition_by"]:
        # Rebalance on the partition columns: few files per date, and AQE
        # splits an oversized (hot) date over several tasks and merges small
        # ones, without a sampling pass over the data.
        out = out.hint("rebalance", *layout["partition_by"])
    else:
        out = out.hint("rebalance")
    # Counted above any exchange: a range sampler runs the subtree below it
    # as a separate job and would otherwise be counted too.
    out = out.observe(obs, F.count(F.lit(1)).alias("rows"))
    if layout["sort_by"]:
        # Leading partition columns keep the writer's required ordering
        # satisfied, so it does not re-sort and lose the key order.
        out = out.sortWithinPartitions(*layout["partition_by"], *layout["sort_by"])
    writer = out.write.mode(mode)
    if layout["partition_by"]:
        writer = writer.partitionBy(*layout["partition_by"])
    writer.parquet(path)
    return int(obs.get.get("rows", 0))


def new_version() -> str:
    """Sortable, unique version tag (UTC time + random suffix)."""
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]


class Stager:
    """Stage tables concurrently under one version, then commit them all."""

    def __init__(self, spark: SparkSession, root: str, version: str | None = None, parallelism: int = 4,
                 layouts: dict | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.version = version or new_version()
        self.layouts = layouts
        self.pool = ThreadPoolExecutor(max_workers=max(1, parallelism))
        self.pending: dict[str, Future] = {}

    def stage(self, name: str, df: DataFrame) -> None:
        path = f"{self.root}/{name}/v={self.version}"
        self.pending[name] = self.pool.submit(write_table, df, path, name, "errorifexists",
                                              _layout(name, self.layouts))

    def commit(self) -> dict:
        """Wait for every staged table, then commit all pointers at once.
        Returns ``{table: rows}``. A failed table aborts the commit, so the
        previously published set stays current."""
        try:
            rows = {name: fut.result() for name, fut in self.pending.items()}
        except BaseException:
            self.abort()
            raise
        self.pool.shutdown(wait=True)
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None).isoformat()

        def point(number: int, state: dict) -> dict:
            return state | {n: {"version": self.version, "path": f"{self.root}/{n}/v={self.version}", "commit": number,
                                "published_at": now, "rows": r} for n, r in rows.items()}
        self.number = commits.commit(self.spark, f"{self.root}/_commits", point)
        return rows

    def abort(self) -> None:
        """Stop staging and delete what this version has written."""
        self.pool.shutdown(wait=True, cancel_futures=True)
        for name in self.pending:
            delete_path(self.spark, f"{self.root}/{name}/v={self.version}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system layer, if it exists."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def last_commit(spark: SparkSession, root: str) -> int:
    """Number of the newest commit, 0 before the first."""
    return (commits.numbers(spark, f"{root.rstrip('/')}/_commits") or [0])[-1]


def publish(spark: SparkSession, root: str, tables: dict, version: str | None = None,
            parallelism: int = 4, layouts: dict | None = None) -> str:
    """Stage every table under one new version, then switch them together."""
    stager = Stager(spark, root, version, parallelism, layouts)
    for name, df in tables.items():
        stager.stage(name, df)
    stager.commit()
    return stager.version


def current_versions(spark: SparkSession, root: str) -> dict:
    """The pointer of every published table: version, path, commit, rows."""
    return commits.newest(spark, f"{root.rstrip('/')}/_commits")[1]


def read_marts(spark: SparkSession, root: str, names, schema=None) -> dict:
    """Published marts by name, all resolved from one commit (another one in
    between changes none or all of them). Missing names are left out. Declared
    schemas are used where known, so partition columns keep their types."""
    pointers = current_versions(spark, root)
    out = {}
    for name in names:
        if name in pointers:
            declared = schema or MART_SCHEMAS.get(name)
            reader = spark.read.schema(declared) if declared is not None else spark.read
            out[name] = reader.parquet(pointers[name]["path"])
    return out


def read_mart(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame:
    """The currently published version of one mart."""
    found = read_marts(spark, root, [name], schema)
    if name not in found:
        raise KeyError(f"mart {name!r} has not been published under {root}")
    return found[name]


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete the folders of all but the newest ``keep`` versions of each
    table; returns how many were deleted. Commit files stay."""
    folder = f"{root.rstrip('/')}/_commits"
    versions: dict[str, list[str]] = {}
    for number in reversed(commits.numbers(spark, folder)):
        for name, pointer in commits.read(spark, folder, number).items():
            paths = versions.setdefault(name, [])
            if pointer["path"] not in paths:
                paths.append(pointer["path"])
    gone = [p for paths in versions.values() for p in paths[keep:] if exists(spark, p)]
    for path in gone:
        delete_path(spark, path)
    return len(gone)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` buckets by ``key``, sorted by it
    inside, and read it back (:func:`read_bucketed`). Tables bucketed alike
    join and aggregate on the key without an exchange. A bucket is read by one
    task, so rows should be few per key (reduced to distinct ones)."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex[:12]}"
    # one task per bucket: as many files as buckets
    (df.repartition(buckets, key).write.format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")          # external: the files stay
    return read_bucketed(spark, path, df.schema, key, buckets)


def read_bucketed(spark: SparkSession, path: str, schema, key: str, buckets: int) -> DataFrame:
    """The bucketed files under ``path`` with their bucketing known to Spark,
    as an external table of the session's catalog named after the path."""
    name = "bucketed_" + hashlib.sha256(f"{path} {key} {buckets}".encode()).hexdigest()[:16]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
              f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows (the DQ log) to a Parquet table."""
    df.coalesce(1).write.mode("append").parquet(path)
