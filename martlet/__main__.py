"""Run the batch pipeline from the command line.

    python -m martlet --behavior log/ --items items.csv --users users.csv \\
        --out s3://bucket/marts --start 2017-11-01 --end 2017-12-10 --tz Asia/Shanghai

Reads the headerless behaviour CSV and the two dimension CSVs (or Parquet
with ``--format parquet``), builds and publishes every mart, appends the DQ
log row and prints the run summary as JSON. On a cluster, submit it with
spark-submit; the launcher's master and memory are used as given.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .constants import DEFAULT_THRESHOLDS, DEFAULT_WEIGHTS
from .plans.etl import run_etl
from .sources.files import read_behavior_lines, read_items_csv, read_users_csv
from . import schemas


def parse_args(argv=None) -> argparse.Namespace:
    """Command-line arguments of the pipeline runner."""
    p = argparse.ArgumentParser(prog="martlet", description=__doc__.splitlines()[0])
    p.add_argument("--behavior", required=True, help="behaviour log path (headerless CSV or Parquet)")
    p.add_argument("--items", required=True, help="item dimension path")
    p.add_argument("--users", required=True, help="user dimension path")
    p.add_argument("--out", required=True, help="publish root on shared storage")
    p.add_argument("--format", choices=("csv", "parquet"), default="csv")
    p.add_argument("--start", help="business window start, YYYY-MM-DD (inclusive)")
    p.add_argument("--end", help="business window end, YYYY-MM-DD (inclusive)")
    p.add_argument("--tz", default="UTC", help="zone that turns event seconds into dates")
    p.add_argument("--model-path", default=None, help="save the KMeans and scaler models here")
    p.add_argument("--materialize", choices=("persist", "table"), default="table")
    p.add_argument("--weights", default=None, help='JSON, e.g. {"R": -0.2, "F": 0.3, "M": 0.5}')
    p.add_argument("--thresholds", default=None, help='JSON, e.g. {"high_r": 0.5, "high_m": 0.3, "high_f": 0.3}')
    return p.parse_args(argv)


def main(argv=None, spark: SparkSession | None = None) -> dict:
    """Read the inputs, run and publish the pipeline, print the run summary."""
    args = parse_args(argv)
    if (args.start is None) != (args.end is None):
        raise SystemExit("--start and --end go together")
    spark = spark or SparkSession.builder.appName("martlet-etl").getOrCreate()
    if args.format == "csv":
        log = read_behavior_lines(spark, args.behavior)
        items = read_items_csv(spark, args.items)
        users = read_users_csv(spark, args.users)
    else:
        log = spark.read.schema(schemas.BEHAVIOR).parquet(args.behavior)
        items = spark.read.schema(schemas.ITEMS).parquet(args.items)
        users = spark.read.schema(schemas.USERS).parquet(args.users)
    summary = run_etl(
        spark, log, items, users, args.out,
        window=(args.start, args.end) if args.start else None, tz=args.tz,
        model_path=args.model_path, materialize=args.materialize,
        weights={**DEFAULT_WEIGHTS, **json.loads(args.weights)} if args.weights else None,
        thresholds={**DEFAULT_THRESHOLDS, **json.loads(args.thresholds)} if args.thresholds else None,
    )
    print(json.dumps(summary, default=str))
    return summary


if __name__ == "__main__":
    main(sys.argv[1:])
