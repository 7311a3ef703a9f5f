"""Helpers shared by the training-data operators.

Tables that are read more than once are written as Parquet under the folder
that the session names in ``spark.checkpoint.dir`` (``session.scratch_path``):
shared by the driver and all executors, so a lost executor costs only a
re-read and lineage stops at a durable file.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a supplied table (column pruning reaches the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise`."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers: once per application a
    zip of its source files goes out with ``addPyFile``. Nothing is done where
    the package already came as such a zip (``--py-files``)."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(context, "_martlet_shipped", False) or not os.path.isdir(root):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="martlet-src-"), "martlet_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    context._martlet_shipped = True


def packed(df: DataFrame, **named: str | F.Column) -> DataFrame:
    """``row`` = the whole input row, beside the named inputs of an operator.

    Packing keeps an operator's own column names apart from any extra columns
    of the caller; ``select("row.*")`` brings the row back unchanged.
    """
    return df.select(F.struct("*").alias("row"), *[
        (F.col(v) if isinstance(v, str) else v).alias(k) for k, v in named.items()])


SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes (views, nothing is copied), so
    that the Python objects made from one part stay few."""
    rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_columns(df: DataFrame, inputs: list[str], keep: list[str], out: T.StructType,
                start: Callable[[], Callable[..., list]]) -> DataFrame:
    """Arrow-batched map: keep columns as they are and append computed ones.

    ``start`` runs once per task and returns a function from the input columns
    of one batch (Arrow arrays) to one Arrow array or list per new field.
    Kept columns pass through without conversion to Python objects.
    """
    ship(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + list(out.fields))
    from pyspark.sql.pandas.types import to_arrow_schema
    types = [f.type for f in to_arrow_schema(out)]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in (part for whole in batches for part in slices(whole)):
            made = function(*[batch.column(c) for c in inputs])
            made = [m if isinstance(m, (pa.Array, pa.ChunkedArray)) else pa.array(m, t)
                    for m, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names)

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)
