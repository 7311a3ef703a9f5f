"""File sources: behaviour log and dimension CSVs with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.dead_letters import parse_lines


def read_behavior_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``user_id,item_id,category_id,type,ts`` rows."""
    return spark.read.schema(schemas.BEHAVIOR).option("header", False).csv(path)


def read_behavior_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same log line by line: (line, reason, log columns), where ``reason``
    says why a line is no row (``operators.dead_letters``)."""
    return parse_lines(spark.read.text(path))


def read_header_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header line, columns matched by NAME (any order, extra
    columns ignored) and cast to the declared types. Values that do not parse
    become NULL (visible to the DQ counters) instead of failing the job, and
    no schema-inference pass over the data is needed."""
    raw = spark.read.option("header", True).csv(path)
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def read_items_csv(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, category_id, price`` with a header line."""
    return read_header_csv(spark, path, schemas.ITEMS)


def read_users_csv(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, age_group, channel`` with a header line."""
    return read_header_csv(spark, path, schemas.USERS)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Any Spark file source by format name."""
    return spark.read.format(fmt).load(path)
