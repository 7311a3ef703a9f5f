"""SimHash near-duplicates by multi-index hashing.

Method: every fingerprint is stored under each of its segments. A query
enumerates a small Hamming ball inside each segment, fetches the table rows
with those segment values, and verifies the complete distance.

With segments of 22, 22 and 20 bits and at most four differing bits, two
fingerprints within reach differ by at most one bit in the first or in the
second segment, or agree in the third (2 + 2 + 1 bits would already be five).
So balls of radius 1, 1 and 0 find every link. A pair at segment distance one
is found from the side that has the 0 there, so only 0 -> 1 flips are probed.

Work is on distinct fingerprints: copies of one text are a single node
whatever their number (partial aggregation absorbs a hot group). Links are
verified inside the join and never listed for equal fingerprints. Both join
sides are shuffled by segment value without a hint, so AQE splits a hot one.
Components come from alternating large-star and small-star rounds over a
written edge table; nothing is collected but a row count and checksum a round.

Edge cases: NULL, empty and blank texts have no words and fingerprint zero,
linked like any other; fewer than four words make one shingle; a NULL doc_id
never names a component (the id is NULL only if no member has one); repeated
rows stay repeated in the result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, map_columns, materialise, table

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (lowest bit, width, ball radius); the radii cover MAX_BITS as shown above.
SEGMENTS = ((0, 22, 1), (22, 22, 1), (44, 20, 0))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text (0 without words)."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64)
    # bit counts in blocks: memory stays bounded for very long texts
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        octets = hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a BIGINT)."""
    def start():
        def run(texts):
            fps = [fingerprint(t, shingle) for t in texts.to_pylist()]
            return [np.array(fps, np.uint64).view(np.int64)]
        return run
    return map_columns(docs, [text], list(keep), T.StructType([T.StructField("fp", T.LongType())]), start)


def _value(fp: F.Column, low: int, width: int) -> F.Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments=SEGMENTS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) that
    differ in at most ``max_bits`` bits; each pair once or more."""
    if sum(r + 1 for _, _, r in segments) <= max_bits:
        raise ValueError("the segments' radii do not cover max_bits")
    if any(r > 1 for _, _, r in segments):
        raise ValueError("probing only 0 -> 1 flips is complete for radii up to one")
    fp = F.col("fp")

    def tag(i, value):
        return F.lit(i << 32).cast("long") + value

    def tagged(i, ball):
        return F.transform(ball, lambda v: tag(i, v))

    def flips(ball, width):
        one = lambda v, k: v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k))
        return F.flatten(F.transform(ball, lambda v: F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: one(v, k)), lambda x: x != v)))

    stored = distinct.select(fp.alias("b"), F.explode(F.array(*[
        tag(i, _value(fp, low, width)) for i, (low, width, _) in enumerate(segments)])).alias("key"))
    balls = []
    for i, (low, width, radius) in enumerate(segments):
        value = _value(fp, low, width)
        ball = F.array(value)
        for _ in range(radius):
            ball = F.array_distinct(F.concat(ball, flips(ball, width)))
        balls.append(tagged(i, ball))
    probes = distinct.select(fp.alias("a"), F.explode(F.concat(*balls)).alias("probe"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return (probes.join(stored, (F.col("probe") == F.col("key")) & (F.col("a") != F.col("b")) & near)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: root is the least
    node of its component. Alternates large-star and small-star rounds, each
    a grouped minimum and a join, until the edge set stops changing."""
    def summary(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = materialise(edges.distinct(), "cc-edges")
    state = summary(now)
    while state[0]:
        # large star: every larger neighbour is linked to the least neighbour
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .where("a < b").distinct())
        # small star: smaller neighbours and the node go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("c"), "b")
                 .select("a", F.explode(F.array("b", "c")).alias("b")).where("a < b").distinct())
        previous, now = now, materialise(small, "cc-edges")
        after = summary(now)
        discard(previous)
        if after == state:
            break
        state = after
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` per input row."""
    return _components_of(docs, doc_id, text, shingle, max_bits).select("doc_id", "fp", "component_id")


def _components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id, root`` per input row; root is the least
    fingerprint of the component, as two components can have one least id."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(fingerprints(base, shingle=shingle), "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    member = materialise(components(links(nodes.select("fp"), max_bits)), "simhash-components")
    # least doc_id per component; fingerprints without a link are their own
    named = nodes.join(member, nodes["fp"] == member["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id", "root")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "root")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each component stays, one whose
    doc_id names it; where no member has an id, any one. Rows go by id and
    fingerprint; only where an id is NULL or repeated are texts read for it."""
    found = materialise(_components_of(docs), "near-dups")
    best = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root")
            .agg(F.min("component_id").alias("best_id"), F.min("fp").alias("best_fp")).drop("root"))
    repeated = materialise(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
                           .select(F.col("doc_id").alias("other_id")), "near-dup-ids")
    out = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("other_id"))
    kept = (docs.where(F.col("doc_id").isNotNull())
            .join(out.union(repeated).distinct(), docs["doc_id"] == F.col("other_id"), "left_anti"))
    special = docs.where(F.col("doc_id").isNull())
    if not repeated.isEmpty():
        special = special.unionByName(docs.join(repeated, docs["doc_id"] == F.col("other_id"), "left_semi"))
    elif found.where(F.col("doc_id").isNull()).isEmpty():
        return kept
    rows = fingerprints(special.select(F.struct("*").alias("row"), "doc_id", "text"), keep=("row", "doc_id"))
    one = (rows.join(best, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("fp") == F.col("best_fp")), "left_semi")
           .dropDuplicates(["doc_id", "fp"]))
    return kept.unionByName(one.select("row.*"))
