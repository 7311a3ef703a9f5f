"""Incremental ingest of the behaviour log with Structured Streaming.

The batch operators are reused unchanged on a file stream:

* ``buy_fact_stream``   dated, windowed, keyed events ⟕ items ⟕ users
                        (stream-static joins), missing price dropped, attributes filled, purchases kept. Stateless,
                        so append mode needs no watermark.
* ``daily_volume_stream`` events and sales per UTC day over an event-time
                        watermark. In append mode a day's row is emitted once
                        the watermark passes its end and its state is dropped
                        (state bounded by the lateness); ``start_table_sink``
                        instead keeps the complete per-day table (one small row
                        per day): each micro-batch is written as a version of its
                        own, which ``read_table_sink`` sees once it is complete.

Sinks write Parquet (partitioned by date) with the checkpoint under the
cluster's ``spark.checkpoint.dir``; a restarted query resumes from its
checkpoint, so executor or driver loss does not duplicate or lose rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import clean, facts
from ..sinks.publish import delete_path, exists


def read_log_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Behaviour-log files arriving in ``path`` (declared schema)."""
    reader = spark.readStream.schema(schemas.BEHAVIOR).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(path)


def buy_fact_stream(log_stream: DataFrame, items: DataFrame, users: DataFrame, window=None,
                    tz: str = "UTC") -> DataFrame:
    """Purchase facts of a log stream (same operators as the batch path)."""
    cl = clean.load_and_clean(log_stream, items, users, window, tz)
    return facts.buy_fact(cl.wide)


def daily_volume_stream(log_stream: DataFrame, items: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Per UTC day: all events, purchases and purchase sales (priced items)."""
    priced = items.select("item_id", F.col("price").alias("_p"))
    ev = (log_stream.withColumn("event_time", F.timestamp_seconds("ts"))
          .withWatermark("event_time", lateness)
          .join(priced, "item_id", "left"))
    is_buy = F.col("type") == "buy"
    return (ev.groupBy(F.window("event_time", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.count_if(is_buy).alias("buys"),
                 F.sum(F.when(is_buy, F.col("_p"))).alias("_s"))
            .select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
                    .alias("date"),
                    "events", "buys", F.col("_s").cast("double").alias("buy_sales")))


def start_table_sink(stream: DataFrame, out_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Complete-mode aggregate: micro-batch n becomes ``out_path/batch=n``. A
    retried batch replaces its own folder; older versions stay whole for
    readers, and the last two are kept."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if batch_id >= 2:
            delete_path(batch.sparkSession, f"{out_path}/batch={batch_id - 2}")
    writer = (stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
              .foreachBatch(write))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_table_sink(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest complete version of a table sink (a version is complete once its
    success marker is written)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(where)
               if s.getPath().getName().startswith("batch=")]
    for n in sorted(numbers, reverse=True):
        if exists(spark, f"{out_path}/batch={n}/_SUCCESS"):
            return spark.read.parquet(f"{out_path}/batch={n}")
    raise FileNotFoundError(f"no complete version under {out_path}")


def stage_files(df: DataFrame, path: str, n_files: int = 4) -> str:
    """Land a DataFrame as ``n_files`` Parquet files (an arriving batch)."""
    df.repartition(n_files).write.mode("append").parquet(path)
    return path


def start_parquet_sink(stream: DataFrame, out_path: str, checkpoint: str,
                       partition_by=("date",), available_now: bool = True,
                       processing_time: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet (partitioned by date) with a checkpoint."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(out_path)
