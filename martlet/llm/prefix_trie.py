"""Prefix trie of conversations, by hashes of fixed-length blocks of turns.

Method: conversations are cut into blocks of ``BLOCK`` turns. A block's key is
the digest of its parent's key and of its turns, so equal keys are equal
prefixes, and conversations are first grouped by block keys alone: one slim row
per conversation and block instead of one per turn. Where a parent has one
block below it, all its conversations go the same way and the block's turns are
a chain with the block's members; nothing is compared there. Only where a
parent has several blocks (siblings diverge) the blocks are opened, and prefixes
of their turns are grouped to find the boundary.

Sums over subtrees need no walk over levels. The owner of a node is its smallest
conversation; the nodes that ``c`` owns are the last ones on its way, from a
first depth on. With ``G(c)`` the length of the text before that depth (all of
it if ``c`` owns nothing) and ``before(v)`` that above the node ``v``,

    sum over the subtree of v of (members - 1) * length
        = sum over the members c of v but its owner of (G(c) - before(v))

because a node is saved once for every member that does not own it. Leaves below
``v`` are the members of ``v`` that own a node without children. Both are sums
over members, so they are grouped as the members are: by blocks, then inside
the diverging ones.

Frequent turns and copies are merged by map-side partial sums. Ids that end at
one node are range-partitioned by node and id, joined to pieces there, and only
the pieces of a node meet, in order, in a running SHA-256, so no list of ids is
held. The turns of one conversation are streamed in order by one task, which
holds one block of them.

Keys are 128-bit digests. Edge cases: rows without ``conv_id`` belong to no
conversation; NULL roles and texts are empty; turns of one number are ordered by
the digest of role and text; repeated rows are turns of their own; a rebuilt
conversation without turns is a member of the root alone; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, ship, table

BLOCK = 4                   # turns of a block
SPREAD = 6                  # first turns taken from the base: fewer than this
EVERY = 100                 # ids of one base
DIGEST = 16                 # bytes
IDS = 1 << 15               # ids of a piece of a node's list
ROOT = bytes(DIGEST)
NOTHING = hashlib.sha256(b"").hexdigest()


def key_of(parent: bytes, turns: bytes) -> bytes:
    """Key of the prefix that goes on from ``parent`` with turns (digests)."""
    return hashlib.blake2b(parent + turns, digest_size=DIGEST).digest()


def _two(key: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", key)


_LONG = T.LongType()
BLOCKS = T.StructType([
    T.StructField("conv_id", _LONG), T.StructField("depth", _LONG), T.StructField("p1", _LONG), T.StructField("p2", _LONG),
    T.StructField("k1", _LONG), T.StructField("k2", _LONG), T.StructField("turns", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("before", _LONG), T.StructField("total", _LONG)])
_BLOCK_TYPES = [pa.int64()] * 6 + [pa.binary(), pa.binary(), pa.int64(), pa.int64()]

NODES = T.StructType([
    T.StructField("k1", _LONG), T.StructField("k2", _LONG), T.StructField("p1", _LONG), T.StructField("p2", _LONG),
    T.StructField("depth", _LONG), T.StructField("before", _LONG), T.StructField("length", _LONG),
    T.StructField("owner", _LONG), T.StructField("n_convs", _LONG), T.StructField("shared", _LONG),
    T.StructField("leaves", _LONG)])


def _flush(rows: list[tuple], types: list[pa.DataType], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.fieldNames())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of conversations from ``conv_id, own, turn_key, length`` rows in
    order. ``total``: the whole length, in a conversation's last row only. A
    conversation without turns is one row with the root's key."""
    out: list[tuple] = []
    conv, parent, depth, before, skip = None, ROOT, 0, 0, 0
    turns: list[bytes] = []
    lengths: list[int] = []

    def close(last: bool):
        nonlocal parent, depth, before
        joined = b"".join(turns)
        key = key_of(parent, joined) if turns else parent
        after = before + sum(lengths)
        out.append((conv, depth, *_two(parent), *_two(key), joined, np.array(lengths, "<i8").tobytes(), before,
                    after if last else None))
        parent, depth, before = key, depth + len(turns), after
        turns.clear()
        lengths.clear()

    for batch in batches:
        for c, own, turn_key, length in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "own", "turn_key", "length"))):
            if c != conv:
                if conv is not None:
                    close(True)
                conv, parent, depth, before, skip = c, ROOT, 0, 0, zlib.crc32(str(c).encode()) % SPREAD
            if own and skip:
                skip -= 1
                continue
            if len(turns) == BLOCK:
                close(False)
            turns.append(turn_key)
            lengths.append(length)
        if len(out) >= 4096:
            yield _flush(out, _BLOCK_TYPES, BLOCKS)
            out.clear()
    if conv is not None:
        close(True)
    if out:
        yield _flush(out, _BLOCK_TYPES, BLOCKS)


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """The blocks of all rebuilt conversations (:data:`BLOCKS`)."""
    ship(conversations.sparkSession)
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    rows = (conversations.where(F.col(conv_id).isNotNull())
            .select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                    F.substring(F.unhex(digest), 1, DIGEST).alias("turn_key"),
                    F.char_length(said).cast("long").alias("length")))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_key")]
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    first = (rows.where(f"conv_id % {EVERY} = 0").withColumn("n", rank).where(F.col("n") < SPREAD)
             .select(F.col("conv_id").alias("base"), F.col("n").cast("long").alias("turn"), "turn_key", "length"))
    convs = (rows.select("conv_id").distinct()
             .withColumn("base", F.expr(f"conv_id - conv_id % {EVERY}"))
             .withColumn("h", F.expr(f"crc32(cast(cast(conv_id as string) as binary)) % {SPREAD}")))
    lent = (convs.join(first, "base").where(F.col("turn") <= F.col("h"))
            .select("conv_id", F.lit(False).alias("own"), "turn", "turn_key", "length"))
    width = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (rows.select("conv_id", F.lit(True).alias("own"), "turn", "turn_key", "length").unionByName(lent)
            .repartition(width, "conv_id").sortWithinPartitions("conv_id", "own", *order)
            .mapInArrow(_cut, BLOCKS))


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node per turn of every block; the sums that differ inside a block
    (``shared``) are one per turn already."""
    names = ("p1", "p2", "depth", "turns", "lengths", "before", "owner", "n_convs", "shared", "leaves")
    for batch in batches:
        out = []
        for p1, p2, depth, turns, lengths, before, owner, n, shared, leaves in zip(*(batch.column(c).to_pylist() for c in names)):
            parent = start = struct.pack("<qq", p1, p2)
            for i, length in enumerate(np.frombuffer(lengths, "<i8").tolist(), 1):
                key = key_of(start, turns[:DIGEST * i])
                out.append((*_two(key), *_two(parent), depth + i, before, length, owner, n, shared[i - 1], leaves))
                parent, before = key, before + length
        for at in range(0, len(out), 8192):
            yield _flush(out[at:at + 8192], [pa.int64()] * 11, NODES)


def nodes(blocks: DataFrame) -> DataFrame:
    """Nodes of the trie but the root, from distinct blocks with their members'
    sums: chains as they are, diverging blocks by the prefixes of their turns."""
    ship(blocks.sparkSession)
    below = blocks.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("k1").alias("s1"), F.min("k2").alias("s2"))
    alone = below.where("n = 1").select("s1", "s2")
    same = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    chains = blocks.join(alone, same, "left_semi").mapInArrow(_open_blocks, NODES)
    prefixes = blocks.join(alone, same, "left_anti").mapInArrow(_open_blocks, NODES)
    refined = prefixes.groupBy("k1", "k2", "p1", "p2", "depth", "before", "length").agg(
        F.min("owner").alias("owner"), F.sum("n_convs").alias("n_convs"), F.sum("shared").alias("shared"),
        F.sum("leaves").alias("leaves"))
    return chains.unionByName(refined)


_BLOCK_KEY = ["k1", "k2", "p1", "p2", "depth", "turns", "lengths", "before"]
ENDS = T.StructType([T.StructField("k1", _LONG), T.StructField("k2", _LONG), T.StructField("first", _LONG),
                     T.StructField("piece", T.BinaryType())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in the order of node and id, joined to pieces of at most ``IDS``."""
    out, node, ids = [], None, []

    def close():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids)).encode()))
            ids.clear()

    types = [pa.int64()] * 3 + [pa.binary()]
    for batch in batches:
        for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "conv_id"))):
            if (k1, k2) != node or len(ids) >= IDS:
                close()
                node = k1, k2
            ids.append(c)
        if len(out) >= 4096:
            yield _flush(out, types, ENDS)
            out.clear()
    close()
    if out:
        yield _flush(out, types, ENDS)


HASHES = T.StructType([T.StructField("k1", _LONG), T.StructField("k2", _LONG), T.StructField("ends_sha256", T.StringType())])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, in order, joined by commas."""
    out, node, so_far = [], None, None
    for batch in batches:
        for k1, k2, piece in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "piece"))):
            if (k1, k2) != node:
                if node is not None:
                    out.append((*node, so_far.hexdigest()))
                node, so_far = (k1, k2), hashlib.sha256()
            else:
                so_far.update(b",")
            so_far.update(piece)
        if len(out) >= 4096:
            yield _flush(out, [pa.int64(), pa.int64(), pa.string()], HASHES)
            out.clear()
    if node is not None:
        out.append((*node, so_far.hexdigest()))
    if out:
        yield _flush(out, [pa.int64(), pa.int64(), pa.string()], HASHES)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``k1, k2, conv_id`` rows."""
    spark = ends.sparkSession
    ship(spark)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = (ends.select("k1", "k2", "conv_id").repartitionByRange(width, "k1", "k2", "conv_id")
              .sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_pieces, ENDS))
    return (pieces.repartition(width, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hash, HASHES))


def trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``: one row per node."""
    of_conv = materialise(sequences(conversations, **columns), "trie-blocks")
    of_turns = of_conv.where(F.length("turns") > 0)
    zero = F.lit(0).cast("long")

    # owners: from the nodes with their smallest members
    distinct = of_turns.groupBy(*_BLOCK_KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"))
    plain = materialise(nodes(distinct.withColumn("shared", F.array_repeat(zero, BLOCK)).withColumn("leaves", zero)),
                        "trie-nodes")
    children = plain.groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count("*").alias("n_children"))
    is_parent = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    owned = plain.join(children, is_parent, "left").groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("top"), F.min("before").alias("own_before"),
        F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    members = materialise(
        of_conv.where(F.col("total").isNotNull()).select("conv_id", F.col("k1").alias("e1"), F.col("k2").alias("e2"), "total")
        .join(owned, "conv_id", "left")
        .select("conv_id", "e1", "e2", F.coalesce("top", F.lit((1 << 63) - 1)).alias("top"),
                F.coalesce("own_before", "total").alias("shared"), F.coalesce("leaf", zero).alias("leaf")), "trie-members")

    # sums over members: per turn of a block, those who do not own it
    shared = F.array(*[F.sum(F.when(F.col("top") > F.col("depth") + i, F.col("shared")).otherwise(zero))
                       for i in range(1, BLOCK + 1)])
    summed = (of_turns.join(members.select("conv_id", "top", "shared", "leaf"), "conv_id").groupBy(*_BLOCK_KEY)
              .agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), shared.alias("shared"),
                   F.sum("leaf").alias("leaves")))
    r1, r2 = _two(ROOT)
    root = members.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum("shared").alias("shared"),
                       F.sum("leaf").alias("leaves")).where("n_convs > 0").select(
        F.lit(r1).cast("long").alias("k1"), F.lit(r2).cast("long").alias("k2"), F.lit(None).cast("long").alias("p1"),
        F.lit(None).cast("long").alias("p2"), zero.alias("depth"), zero.alias("before"), zero.alias("length"), "owner",
        "n_convs", "shared", F.greatest("leaves", F.lit(1)).alias("leaves"))
    full = materialise(nodes(summed).unionByName(root), "trie-nodes")

    hashes = end_hashes(members.select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id"))
    above = full.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("owner").alias("parent_conv_id"))
    out = materialise(
        full.join(children, is_parent, "left").join(hashes, ["k1", "k2"], "left")
        .join(above, (F.col("p1") == F.col("a1")) & (F.col("p2") == F.col("a2")), "left")
        .select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
                F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"),
                (F.col("shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), "trie")
    for made in (of_conv, plain, members, full):
        discard(made)
    return out


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
