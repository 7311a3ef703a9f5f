"""Numbered commits in a folder, by optimistic concurrency.

A commit is one small file, ``commit-<number>.json``, that holds the whole state
(here: which version of each mart is current). A writer takes the newest state,
applies its change and creates the next number; the file is created only if
it is absent and appears with all its content, so of two writers with one number
exactly one succeeds and the other starts again from the state it lost to. No
number is used twice, no commit is lost, and a reader that opens the newest file
sees one whole state.

How a file is created only if absent depends on the file system: on a local one
by a hard link to a finished file, elsewhere by a rename that does not overwrite
(atomic on HDFS; an object store needs a connector whose rename or create is).
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_NAME = re.compile(r"commit-(\d{12})\.json")
RETRIES = 100


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of all commits, ascending."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return []
    found = (_NAME.fullmatch(f.getPath().getName()) for f in fs.listStatus(where))
    return sorted(int(m.group(1)) for m in found if m)


def read(spark: SparkSession, folder: str, number: int) -> dict:
    """The state of one commit; 0 is the empty state before the first."""
    if number == 0:
        return {}
    fs, where = _fs(spark, f"{folder}/commit-{number:012d}.json")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def newest(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, state) of the newest commit."""
    found = numbers(spark, folder)
    last = found[-1] if found else 0
    return last, read(spark, folder, last)


def _link(spark: SparkSession, draft: str, target: str, text: str) -> bool:
    """Local file system: a hard link to a finished file, which fails if the
    name is taken."""
    draft, target = (spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in (draft, target))
    with open(draft, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, target)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


def _rename(spark: SparkSession, draft: str, target: str, text: str) -> bool:
    """Any Hadoop file system: a rename that does not overwrite."""
    fs, start = _fs(spark, draft)
    out = fs.create(start, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(
            fs.makeQualified(start), fs.makeQualified(_fs(spark, target)[1]), options)
        return True
    except Exception as e:
        fs.delete(start, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def create(spark: SparkSession, folder: str, number: int, state: dict) -> bool:
    """Create commit ``number``; False if it exists already."""
    fs, root = _fs(spark, folder)
    fs.mkdirs(root)
    put = _link if fs.getUri().getScheme() == "file" else _rename
    return put(spark, f"{folder}/.draft-{uuid.uuid4().hex}", f"{folder}/commit-{number:012d}.json",
               json.dumps(state, sort_keys=True))


def commit(spark: SparkSession, folder: str, change: Callable[[int, dict], dict]) -> int:
    """Apply ``change(number, state)`` to the newest state and commit what it
    returns; the commit's number. Tried again whenever another writer was first."""
    for _ in range(RETRIES):
        last, state = newest(spark, folder)
        if create(spark, folder, last + 1, change(last + 1, state)):
            return last + 1
    raise RuntimeError(f"no commit to {folder} succeeded in {RETRIES} attempts")
