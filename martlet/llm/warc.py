"""WARC archives as a chunked record table.

Method: archives are read as rows of (record id, chunk number, bytes), each
carrying the SHA-1 and length of the payload so far; the last chunk of a record
carries its full digest. ``read`` streams chunks and never needs a whole record
in one buffer; the round trip reads without bytes and keeps only last chunks.
The write path is not chunked into rows: a payload is a value of the pages
table and comes as one Arrow buffer, which digests, compression and output walk
in views of ``CHUNK`` bytes without a copy of the whole. Its memory grows with
the largest payload in a batch.

* Digests of payloads come first (one pass). Equal payloads are found by a
  grouped maximum with map-side partial aggregation, so a payload that a third
  of all rows share costs one row per task; the join back to the rows is left
  to Spark, which broadcasts a small side or splits a hot key.
* Each task writes its records to one archive in the shared folder: under a
  name of its own attempt first, then renamed. A retried or speculative task
  leaves at most an unfinished file that no manifest row names.
* Each record is a gzip member of its own, as is usual for archives: chunks are
  compressed and decompressed as they stream by.
* The manifest (path, size, records) is a written table; the reader deals
  archives out to tasks by it and streams each file in blocks.
* Archive files go through the file system that the folder's URI names.

Edge cases: NULL payloads are empty; empty payloads are equal to each other; a
NULL record id is written with the id ``null`` and read back as NULL; one id
may come with several payloads, a revisit means the one of its digest; repeated
rows are records of their own, and of equal rows with the largest id all are
responses; an empty table gives an empty manifest and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import map_columns, materialise, ship, table

CHUNK = 256 << 10
LEVEL = 1             # of compression: archives are read soon and often
MIN_REVISIT = 0       # payloads from this size on are written once
DATE = "2024-01-01T00:00:00Z"
ID = "urn:record:"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(payload, size: int = CHUNK) -> Iterator[tuple[int, memoryview, bytes, int, bool]]:
    """(chunk number, bytes, SHA-1 so far, length so far, last) of a buffer,
    as views; an empty payload is one empty chunk."""
    view, so_far = memoryview(payload), hashlib.sha1()
    for number, at in enumerate(range(0, max(1, len(view)), size)):
        part = view[at:at + size]
        so_far.update(part)
        yield number, part, so_far.digest(), at + len(part), at + size >= len(view)


def payload_digests(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``payload_digest`` and ``payload_bytes`` per row
    (payload: ``html``)."""

    def start():
        def run(texts):
            out = []
            for t in pa.array(texts).cast(pa.binary()):
                for _, _, digest, n, _ in chunks(t.as_buffer() if t.is_valid else b""):
                    pass
                out.append((base32_sha1(digest), n))
            return [[d for d, _ in out], [n for _, n in out]]
        return run
    return map_columns(rows, ["html"], list(keep), T.StructType([
        T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType())]), start)


def with_types(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
               least: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html, response_id`` (NULL for responses): of equal
    payloads the row with the largest id is the response. Rows go by id and
    digest, as one id can come with several payloads."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("html"))
    digests = materialise(payload_digests(rows, "page_id"), "warc-digests")
    first = (digests.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
             .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1"))
    revisits = (digests.join(first, ["payload_digest", "payload_bytes"])
                .where(F.col("page_id") != F.col("response_id"))
                .select(F.col("page_id").alias("revisit_id"), F.col("payload_digest").alias("revisit_digest"),
                        "response_id").distinct())
    return (payload_digests(rows, *rows.columns)
            .join(revisits, (F.col("page_id") == F.col("revisit_id"))
                  & (F.col("payload_digest") == F.col("revisit_digest")), "left")
            .select(*rows.columns, "response_id"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def record_head(kind: str, record_id, url, length: int, digest: str, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'null' if record_id is None else record_id}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{ID}{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()),
                         T.StructField("records", T.LongType())])


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, response_id`` rows as archives in ``folder``;
    returns the manifest, a written table. The head needs the full digest, so
    a payload's chunks are walked twice, over the same buffer."""
    ship(records.sparkSession)

    def run(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        partial = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(partial, buffer_size=1 << 20) as out:
            for batch in batches:
                bodies = batch.column("html").cast(pa.binary())
                for i in range(batch.num_rows):
                    body = bodies[i].as_buffer() if bodies[i].is_valid else b""
                    for _, _, digest, length, _ in chunks(body):
                        pass
                    refers = batch.column("response_id")[i].as_py()
                    member = zlib.compressobj(LEVEL, wbits=31)
                    out.write(member.compress(record_head(
                        "response" if refers is None else "revisit", batch.column("page_id")[i].as_py(),
                        batch.column("url")[i].as_py(), length if refers is None else 0, base32_sha1(digest), refers)))
                    if refers is None:
                        for _, view, _, _, _ in chunks(body):
                            out.write(member.compress(view))
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    n += 1
            size = out.tell()
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        if n:
            system.move(partial, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})
        else:
            system.delete_file(partial)

    made = records.select("page_id", "url", "html", "response_id").mapInArrow(run, MANIFEST)
    return materialise(made, "warc-manifest")


class Stream:
    """Blocks of a file as lines and byte counts, with one block in memory."""

    def __init__(self, source, block: int = CHUNK):
        self.source, self.block, self.held = source, block, b""

    def line(self) -> bytes:
        while (end := self.held.find(b"\r\n")) < 0:
            more = self.source.read(self.block)
            if not more:
                line, self.held = self.held, b""
                return line
            self.held += more
        line, self.held = self.held[:end], self.held[end + 2:]
        return line

    def parts(self, length: int, size: int) -> Iterator[bytes]:
        while length:
            if not self.held:
                self.held = self.source.read(min(self.block, length))
                if not self.held:
                    raise ValueError("archive ends inside a record")
            part, self.held = self.held[:min(length, size)], self.held[min(length, size):]
            length -= len(part)
            yield part

    def ended(self) -> bool:
        if not self.held:
            self.held = self.source.read(self.block)
        return not self.held


CHUNKS = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("declared_digest", T.StringType()), T.StructField("chunk", T.LongType()),
    T.StructField("content", T.BinaryType()), T.StructField("bytes_so_far", T.LongType()),
    T.StructField("digest_so_far", T.StringType()), T.StructField("last", T.BooleanType())])


def _number(value: str | None) -> int | None:
    inner = value.strip("<>").removeprefix(ID) if value else "null"
    return None if inner == "null" else int(inner)


def read_records(source, size: int = CHUNK, content: bool = True) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` from one open archive, in order."""
    stream = Stream(source)
    while not stream.ended():
        if not stream.line().startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {}
        while line := stream.line():
            name, _, value = line.decode().partition(": ")
            head[name.lower()] = value
        length, so_far, n = int(head["content-length"]), hashlib.sha1(), 0
        key = (_number(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"),
               _number(head.get("warc-refers-to")), head["warc-payload-digest"].partition(":")[2])
        number = 0
        for part in stream.parts(length, size) if length else (b"",):
            so_far.update(part)
            n += len(part)
            yield (*key, number, part if content else None, n, base32_sha1(so_far.digest()), n == length)
            number += 1
        if stream.line() or stream.line():
            raise ValueError("a record does not end with two empty lines")


def read(manifest: DataFrame, content: bool = True, rows: int = 256) -> DataFrame:
    """The chunk table of all archives of a manifest. Batches hold ``rows``
    chunks at most; ``content=False`` leaves the bytes out of the rows."""
    spark = manifest.sparkSession
    ship(spark)
    # archives are dealt out by number: they are many and of similar size
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(),
             pa.string(), pa.bool_()]

    def run(batches):
        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], CHUNKS.fieldNames())
        held = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system = scheme_system
                with system().open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as source:
                    for row in read_records(source, content=content):
                        held.append(row)
                        if len(held) >= (rows if content else 16 * rows):
                            yield flush(held)
                            held = []
        if held:
            yield flush(held)

    folder = manifest.limit(1).collect()
    root = getattr(manifest, "_root", None) or (os.path.dirname(folder[0].path) if folder else "")
    scheme_system = lambda: _open(root)[0]
    return manifest.repartition(width, "path").mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write all rows as archives, read them back, and return per record
    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. A
    revisit's payload is that of the record it refers to."""
    manifest = write(with_types(pages, **columns), folder)
    manifest._root = folder
    ends = materialise(read(manifest, content=False).where("last"), "warc-records")
    whole = ends.where("record_type = 'response'")
    payloads = whole.select(F.col("record_id").alias("r_id"), F.col("bytes_so_far").alias("r_bytes"),
                            F.col("digest_so_far").alias("r_digest")).distinct()
    revisit = ends.where("record_type = 'revisit'").join(
        payloads, (F.col("refers_to") == F.col("r_id")) & (F.col("declared_digest") == F.col("r_digest")), "left")
    check = lambda d: F.when(F.col("declared_digest") == F.col(d), F.col(d)).otherwise(
        F.raise_error(F.lit("a payload does not match its declared digest")))
    return whole.select(F.col("record_id").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"),
                        check("digest_so_far").alias("payload_digest"), "record_type", "refers_to").unionByName(
        revisit.select(F.col("record_id").alias("page_id"), F.col("r_bytes").alias("payload_bytes"),
                       check("r_digest").alias("payload_digest"), "record_type", "refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"), scratch_path(spark, "warc"))
