"""Token ids as binary files: Simple-8b blocks in ascending document order.

Rows are range-partitioned by document id (ties by text, then by place, so that
no id, however frequent, has to stay in one partition) and sorted; each task
encodes its texts, appends the end id to each and writes one file:

    magic, blocks, footer, length of the footer, magic

A block is up to ``BLOCK`` ids as Simple-8b words (:mod:`.simple8b`), followed
by its escaped values. The footer has, per block, its offset and its numbers of
words, escapes and ids, and, per document, its id and number of ids: any
document is found by a running sum, and any block is decoded alone by numpy.
Blocks do not end with documents; ids of a document of any length go through
one block's memory at a time.

A file is written under a name of its task attempt and renamed when it is
whole; the manifest, a written table of one row per file, names only files of
attempts that succeeded, so lost executors leave no wrong file behind. The
first global position of each file is a running sum over the manifest.

The tokenizer is the library's; texts are cut into parts that it sees once
(:mod:`.parts`), which gives the library's ids for the whole texts.

Edge cases: NULL and empty texts have the end id alone; NULL document ids come
first; rows with one id are documents of their own, ordered by the hash of
their text and then by their place in the input; an empty table gives no file
and an empty result; ids of 64 bits are kept exactly.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from . import simple8b
from .common import materialise, ship, slices, table
from .parts import LINE, Encoder
from .token_counts import tokenizer
from .warc import _open

BLOCK = 1 << 16             # ids of a block
MAGIC = b"S8B-IDS1"
END = 0                     # id that ends a document
KNOWN = 600_000             # parts whose ids are kept
TOGETHER = 200              # parts the tokenizer gets as one text
_encoders: dict[str, Encoder] = {}


_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch
# byte-level vocabularies write bytes that are no visible Latin-1 character as
# the characters from U+0100 on, in order: a space U+0120, a line end U+010A
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELL = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
SPACE, LINE_END = chr(_SPELL[32]), chr(_SPELL[10])


def spelled(part: str) -> str | None:
    """A blank and a word of letters as the vocabulary writes them, piece by
    piece; None for other parts."""
    word = part[1:]
    if not _LETTERS(word):
        return None
    if not word.isascii():
        word = word.encode().decode("latin-1").translate(_SPELL)
    return SPACE + word if part[0] == " " else LINE_END + " " + word


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    found = _encoders.get(path)
    if found is not None:
        return found
    made = tokenizer(path)
    from tokenizers import Tokenizer, pre_tokenizers
    # the same merges for text that is spelled and cut already
    words = Tokenizer(Tokenizer.from_file(path).model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    opens = np.zeros(made.get_vocab_size(with_added_tokens=True), bool)
    for token, i in made.get_vocab(with_added_tokens=True).items():
        opens[i] = token[:1] in (SPACE, LINE_END)

    def each(parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in made.encode_batch_fast(parts, add_special_tokens=False)]

    def together(parts: list[str], texts: list[str], coder, between: str) -> list[bytes]:
        """Parts that begin with a blank and have no other space or line end
        are encoded as one text: their ids begin where a token does so."""
        out: list[bytes] = []
        for at in range(0, len(parts), TOGETHER):
            text = between.join(texts[at:at + TOGETHER])
            ids = np.array(coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            starts = np.flatnonzero(opens[ids])
            some = parts[at:at + TOGETHER]
            if len(starts) == len(some) and starts[0] == 0:
                edges = [*(4 * starts).tolist(), 4 * len(ids)]
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip(edges, edges[1:])]
            else:
                out += each(some)
        return out

    def many(parts: list[str]) -> list[bytes]:
        if not all(p[:1] in (" ", LINE) and len(p) > 1 for p in parts):
            return each(parts)
        texts = [spelled(p) for p in parts]
        plain = [p for p, t in zip(parts, texts) if t is not None]
        other = [p for p, t in zip(parts, texts) if t is None]
        ids = iter(together(plain, [t for t in texts if t is not None], words, " "))
        rest = iter(together(other, other, made, ""))
        return [next(rest) if t is None else next(ids) for t in texts]

    found = _encoders[path] = Encoder(many, KNOWN)
    if len(found.line) != 1:
        raise ValueError(f"{LINE!r} is not one token")
    return found


MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()),
    T.StructField("bytes", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("n_ids", T.LongType())])


class Writer:
    """One file of ids; memory: one block and 17 bytes per document."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.doc_ids: list[np.ndarray] = []
        self.named: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, named: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.named.append(named)
        self.counts.append(counts)
        self.held.append(ids if ids.dtype == np.uint64 else ids.astype(np.uint32))
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            self._write(BLOCK)

    def _write(self, least: int) -> None:
        """Whole blocks; with ``least`` 1 also the last, shorter one."""
        ids = np.concatenate(self.held)
        at = 0
        while len(ids) - at >= least:
            some = ids[at:at + BLOCK]
            words, escapes = simple8b.pack(some)
            self.blocks.append((self.at, len(words), len(escapes), len(some)))
            self.out.write(words.astype("<u8").tobytes())
            self.out.write(escapes.astype("<u8").tobytes())
            self.at += 8 * (len(words) + len(escapes))
            at += len(some)
        self.held, self.n_held = [ids[at:]], len(ids) - at

    def close(self) -> int:
        """Write what is left and the footer; the number of documents."""
        if self.n_held:
            self._write(1)
        counts = np.concatenate(self.counts)
        footer = (struct.pack("<QQ", len(self.blocks), len(counts))
                  + np.array(self.blocks, "<i8").reshape(-1, 4).tobytes()
                  + np.concatenate(self.doc_ids).astype("<i8").tobytes()
                  + np.concatenate(self.named).astype("u1").tobytes() + counts.astype("<i8").tobytes())
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return len(counts)


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
          end: int = END) -> DataFrame:
    """Write the ids of all rows as files in ``folder``; returns the manifest,
    a written table with ``start``, the ids before each file."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)

    def run(batches):
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        partial = f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        coder, writer = encoder(path), None
        with system.open_output_stream(partial, buffer_size=1 << 20) as out:
            for batch in (x for whole in batches for x in slices(whole)):
                ids, counts = coder.encode(batch.column("text"))
                edges = np.cumsum(counts)
                ids = np.insert(ids, edges, end)
                named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                writer = writer or Writer(out)
                writer.add(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), named, ids, counts + 1)
            n = writer.close() if writer else 0
            size = out.tell()
        if not n:
            system.delete_file(partial)
            return
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex[:8]}.ids"
        system.move(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in (
            (part, pa.int32()), (name, pa.string()), (size, pa.int64()), (n, pa.int64()), (writer.n_ids, pa.int64()))],
            MANIFEST.fieldNames())

    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
            .repartitionByRange(width, *key).sortWithinPartitions(*key).select("doc_id", "text"))
    made = materialise(rows.mapInArrow(run, MANIFEST), "ids-manifest")
    # one row per file, of which there are at most as many as shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


class Reader:
    """One file of ids."""

    def __init__(self, file):
        self.file = file
        file.seek(0)
        if file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of ids")
        file.seek(file.size() - 8 - len(MAGIC))
        tail = file.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("a file of ids that was not ended")
        length, = struct.unpack("<Q", tail[:8])
        file.seek(file.size() - 8 - len(MAGIC) - length)
        footer = file.read(length)
        blocks, docs = struct.unpack_from("<QQ", footer)
        at = 16
        self.blocks = np.frombuffer(footer, "<i8", 4 * blocks, at).reshape(-1, 4)
        at += 32 * blocks
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.named = np.frombuffer(footer, "u1", docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(footer, "<i8", docs, at + 9 * docs)
        self.first = np.concatenate(([0], np.cumsum(self.blocks[:, 3])))

    def block(self, i: int) -> np.ndarray:
        at, words, escapes, n = self.blocks[i].tolist()
        self.file.seek(at)
        data = np.frombuffer(self.file.read(8 * (words + escapes)), "<u8")
        out = simple8b.unpack(data[:words], data[words:])
        if len(out) != n:
            raise ValueError("a block has another number of ids than its entry")
        return out

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids by place: only the blocks that hold them are read."""
        a, b = np.searchsorted(self.first, [start, start + count - 1], "right") - 1 if count else (0, -1)
        found = [self.block(i) for i in range(a, b + 1)]
        return np.concatenate(found)[start - self.first[a]:][:count] if found else np.empty(0, np.uint64)

    def documents(self) -> Iterator[tuple[int, int, Iterator[np.ndarray]]]:
        """(number, first place, its ids in runs) of all documents, in order;
        the runs are to be taken before the next document."""
        block, i, at = np.empty(0, np.uint64), 0, 0

        def runs(left: int):
            nonlocal block, i, at
            while left:
                if at == len(block):
                    block, i, at = self.block(i), i + 1, 0
                run = block[at:at + left]
                at += len(run)
                left -= len(run)
                yield run

        place = 0
        for n, count in enumerate(self.counts.tolist()):
            yield n, place, runs(count)
            place += count


def read(manifest: DataFrame, folder: str, content: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document of the files of a
    manifest, with ``content`` also ``ids``."""
    spark = manifest.sparkSession
    ship(spark)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    types = [pa.int64()] * 4
    if content:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
        types.append(pa.list_(pa.int64()))
    schema = T.StructType(fields)

    def run(batches):
        system = _open(folder)[0]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with system.open_input_file(path) as file:
                    reader, rows, held = Reader(file), [], 0
                    for n, place, ids_of in reader.documents():
                        crc, ids = 0, []
                        for ids_run in ids_of:
                            crc = zlib.crc32(ids_run.astype("<u4").tobytes(), crc)
                            if content:
                                ids.append(ids_run.astype(np.int64))
                        count = int(reader.counts[n])
                        row = (int(reader.doc_ids[n]) if reader.named[n] else None, start + place, count, crc)
                        rows.append((*row, np.concatenate(ids)) if content else row)
                        held += count if content else 1
                        if held >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.fieldNames())
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.fieldNames())

    # files are dealt out one by one: there is one row per file
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path", "start").repartition(width).mapInArrow(run, schema)


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    return read(write(table(spark, sf_dir, "documents", "doc_id", "text"), folder), folder)
