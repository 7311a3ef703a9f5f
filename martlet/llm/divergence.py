"""Source divergence audit: how far the sources of a language differ in words.

Method: single-pass in-memory indexing, then streamed pair corrections.

* Every task reads its texts once and builds one block of postings in memory
  (per language, source and term: occurrences and documents). When the block
  holds ``MOST_POSTINGS`` it is spilled as a run, sorted by hash shard,
  language and term, in segments of ``SEGMENT`` postings.
* Runs meet by hash shard. A heap holds the head of every segment under way;
  segments enter when their first term is reached and leave when read, so a
  shard is merged as a stream. A frequent term is one posting per run and
  source by then. Out come the frequencies of the kept terms: a written table.
* The smoothed shares are integers, worked out in decimals. With ``f`` the
  divergence of two shares, ``p0`` a group's share of a term it lacks, the sum
  over all ``V`` terms is

      sum_t f(p_a(t), p0_b) + sum_t f(p0_a, p_b(t)) - V f(p0_a, p0_b)
        + sum over terms of both groups of
          [f(p_a, p_b) - f(p_a, p0_b) - f(p0_a, p_b) + f(p0_a, p0_b)]

  The first two sums need only how many terms of a group have each count. The
  corrections are streamed: a task adds those of its terms up per pair of
  groups and hands the sums on when it holds ``MOST_PAIRS`` of them. Terms of
  very many groups are dealt out in slices. No absent term is ever visited.

A pair is a row of the report, so pairs of sources are its size; nothing else
grows with them. Arithmetic is exact: shares below 2^31, products below 2^63,
counts beyond that in decimals.

Edge cases: NULL text, language and source are ``''``; rows count as documents
one by one; a group without kept terms, or a language without any, has value 0
for every pair and no term rows; a language with one source has no pairs; ties
go by the item's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, ship, slices, table

LEAST_DOCS = 10             # documents of the language that keep a term
SCALE = 1_000_000_000
TOP = 10
MOST_POSTINGS = 400_000     # postings of a block before it is spilled
SEGMENT = 1024              # postings of a segment of a run
PIECE = 1 << 20             # bytes of a text that become words at a time
MOST_PAIRS = 500_000        # pair sums a task holds
SLICE = 512                 # groups of a term that one row pairs with the others
GROUP = b"#"                # marks that a group occurs; no term has this character

# letters in lower case, all beyond ASCII as it is, anything else a blank
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RUNS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("lang", T.StringType()),
    T.StructField("first", T.BinaryType()), T.StructField("terms", T.BinaryType()),
    T.StructField("sources", T.ArrayType(T.StringType())), T.StructField("which", T.BinaryType()),
    T.StructField("times", T.BinaryType()), T.StructField("docs", T.BinaryType())])
_RUN_TYPES = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

FREQUENCIES = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("term", T.StringType()),
    T.StructField("total", T.LongType()), T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("counts", T.ArrayType(T.LongType()))])
_FREQUENCY_TYPES = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in order, some at a time."""
    letters = text.translate(_LETTERS)
    at = 0
    while len(letters) - at > PIECE:
        cut = letters.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield letters[at:cut].split()
        at = cut
    yield letters[at:].split()


class Block:
    """Postings in memory: per (lang, source), occurrences and documents."""

    def __init__(self):
        self.times: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.size = 0

    def add(self, group: tuple[str, str], text: bytes | None) -> None:
        times = self.times.setdefault(group, Counter())
        docs = self.docs.setdefault(group, Counter())
        before = len(docs)
        docs[GROUP] += 1
        seen: set[bytes] = set()
        for words in terms(text or b""):
            times.update(words)
            seen.update(words)
        docs.update(seen)
        self.size += len(docs) - before

    def run(self, shards: int, segment: int = SEGMENT) -> Iterator[tuple]:
        """Segments of the block, sorted by shard, language and term."""
        langs = sorted({g[0] for g in self.docs})
        names = sorted({g[1] for g in self.docs})
        lang_at, name_at = {x: i for i, x in enumerate(langs)}, {x: i for i, x in enumerate(names)}
        words, shard, lang, which, times, docs = [], [], [], [], [], []
        for group, counted in self.docs.items():
            start, n = zlib.crc32(group[0].encode()), len(counted)
            found = self.times[group]
            words += counted
            shard += [zlib.crc32(w, start) % shards for w in counted]
            lang.append(np.full(n, lang_at[group[0]], np.int32))
            which.append(np.full(n, name_at[group[1]], np.uint32))
            times += [found[w] for w in counted]
            docs += counted.values()
        lang, which = np.concatenate(lang), np.concatenate(which)
        shard, times, docs = np.array(shard, np.int32), np.array(times, np.int64), np.array(docs, np.int64)
        order = pc.sort_indices(pa.table({"s": shard, "l": lang, "w": pa.array(words, pa.binary()), "n": which}),
                                [(k, "ascending") for k in "slwn"]).to_numpy()
        lang, which, shard, times, docs = lang[order], which[order], shard[order], times[order], docs[order]
        words = [words[i] for i in order.tolist()]
        edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(lang) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(words)]):
            for i in range(a, b, segment):
                j = min(b, i + segment)
                used, index = np.unique(which[i:j], return_inverse=True)
                yield (int(shard[i]), langs[lang[i]], words[i], b" ".join(words[i:j]), [names[k] for k in used],
                       index.astype(np.uint32).tobytes(), times[i:j].tobytes(), docs[i:j].tobytes())


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def runs(docs: DataFrame, shards: int, most: int = MOST_POSTINGS, segment: int = SEGMENT) -> DataFrame:
    """Segments of the runs of ``text, lang, source`` rows."""
    ship(docs.sparkSession)

    def make(batches):
        def spill(block):
            held = []
            for row in block.run(shards, segment):
                held.append(row)
                if len(held) >= 256:
                    yield _batch(held, _RUN_TYPES, RUNS.fieldNames())
                    held = []
            if held:
                yield _batch(held, _RUN_TYPES, RUNS.fieldNames())

        block = Block()
        for batch in (part for whole in batches for part in slices(whole)):
            langs, names = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for text, lang, source in zip(batch.column("text").cast(pa.binary()), langs, names):
                block.add((lang or "", source or ""), text.as_py())
                if block.size >= most:
                    yield from spill(block)
                    block = Block()
        if block.docs:
            yield from spill(block)

    return docs.select("text", "lang", "source").mapInArrow(make, RUNS)


class Segment:
    """The postings of a segment, one term's after another's."""

    def __init__(self, row: dict):
        self.words = row["terms"].split(b" ")
        names = row["sources"]
        self.names = [names[i] for i in np.frombuffer(row["which"], np.uint32).tolist()]
        self.times = np.frombuffer(row["times"], np.int64).tolist()
        self.docs = np.frombuffer(row["docs"], np.int64).tolist()
        self.at = 0


def merged(segments: Iterator[dict]) -> Iterator[tuple[str, bytes, int, dict[str, int]]]:
    """(lang, term, documents, occurrences by source) from segments in the
    order of shard, language and first term."""
    heap: list[tuple[bytes, int, Segment]] = []
    serial = 0

    def drain(before: bytes | None):
        while heap and (before is None or heap[0][0] < before):
            word, found, n_docs = heap[0][0], {}, 0
            while heap and heap[0][0] == word:
                _, number, s = heap[0]
                at, words = s.at, s.words
                while at < len(words) and words[at] == word:
                    found[s.names[at]] = found.get(s.names[at], 0) + s.times[at]
                    n_docs += s.docs[at]
                    at += 1
                s.at = at
                if at < len(words):
                    heapq.heapreplace(heap, (words[at], number, s))
                else:
                    heapq.heappop(heap)
            yield word, n_docs, found

    now = None
    for row in segments:
        key = row["shard"], row["lang"]
        for x in drain(None if key != now else row["first"]):
            yield (now[1], *x)
        now = key
        segment = Segment(row)
        heapq.heappush(heap, (segment.words[0], serial, segment))
        serial += 1
    for x in drain(None):
        yield (now[1], *x)


def frequencies(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_POSTINGS,
                segment: int = SEGMENT) -> DataFrame:
    """``lang, term, total, sources, counts``: one row per kept term, and one
    per language with the term ``#`` whose sources are all its groups."""
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    made = runs(docs, 8 * width, most, segment)

    def merge(batches):
        rows = (row for batch in batches for part in slices(batch, 1 << 20) for row in part.to_pylist())
        held, size = [], 0
        for lang, word, n_docs, found in merged(rows):
            if n_docs >= least or word == GROUP:
                names = sorted(found)
                held.append((lang, word.decode(), sum(found.values()), names, [found[x] for x in names]))
                size += 1 + len(names)
                if size >= 32768:
                    yield _batch(held, _FREQUENCY_TYPES, FREQUENCIES.fieldNames())
                    held, size = [], 0
        if held:
            yield _batch(held, _FREQUENCY_TYPES, FREQUENCIES.fieldNames())

    return (made.repartition(width, "shard").sortWithinPartitions("shard", "lang", "first")
            .mapInArrow(merge, FREQUENCIES))


def _share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), NULL without terms."""
    wide = "cast({} as decimal(20,0))".format
    return F.expr(f"1 + case when {kept} > 0 then (cast({SCALE} as decimal(10,0)) * ({wide(count)} + 2)) "
                  f"div ({wide(total)} + 2 * {wide(kept)}) end")


def _f(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


PAIRS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.StringType()),
                      T.StructField("b", T.StringType()), T.StructField("value", T.LongType())])


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PairSums:
    """Corrections per pair of sources of one language, held up to a limit."""

    def __init__(self, most: int = MOST_PAIRS):
        self.most = most
        self.number: dict[str, int] = {}
        self.keys, self.values, self.size = [], [], 0

    def add(self, who: np.ndarray, p: np.ndarray, p0: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Rows are terms with equally many groups; pairs of columns i, j."""
        a, b, pa_, pb, a0, b0 = who[:, i], who[:, j], p[:, i], p[:, j], p0[:, i], p0[:, j]
        value = _divergence(pa_, pb) - _divergence(pa_, b0) - _divergence(a0, pb) + _divergence(a0, b0)
        self.keys.append((np.minimum(a, b) << 32 | np.maximum(a, b)).ravel())
        self.values.append(value.ravel())
        self.size += value.size
        if self.size > 8 * self.most:
            self.fold()

    def fold(self) -> None:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        keys, at = np.unique(keys, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, values)
        self.keys, self.values, self.size = [keys], [sums], len(keys)

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self.fold()
        names = list(self.number)
        for at in range(0, self.size, 8192):
            k, v = self.keys[0][at:at + 8192], self.values[0][at:at + 8192]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(k), pa.string()), pa.array([names[x] for x in (k >> 32).tolist()], pa.string()),
                pa.array([names[x] for x in (k & 0xFFFFFFFF).tolist()], pa.string()), pa.array(v)], PAIRS.fieldNames())
        self.keys, self.values, self.size = [], [], 0


def corrections(terms_of: DataFrame, slice_size: int = SLICE, most: int = MOST_PAIRS) -> DataFrame:
    """(lang, a, b, value): the pair corrections of ``lang, of`` rows, where
    ``of`` are a term's groups (source, p, p0), added up as far as tasks hold
    them. A row pairs ``slice_size`` of its groups with all after them."""
    ship(terms_of.sparkSession)

    def run(batches):
        sums: dict[str, PairSums] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            rows: dict[tuple[str, int, int], list[list[dict]]] = {}
            for lang, lo, of in zip(*(batch.column(c).to_pylist() for c in ("lang", "lo", "of"))):
                rows.setdefault((lang, lo, len(of)), []).append(of)
            for (lang, lo, k), alike in rows.items():
                s = sums.setdefault(lang, PairSums(most))
                flat = [x for of in alike for x in of]
                who = np.array([s.number.setdefault(x["source"], len(s.number)) for x in flat], np.int64).reshape(-1, k)
                p = np.array([x["p"] for x in flat], np.int64).reshape(-1, k)
                p0 = np.array([x["p0"] for x in flat], np.int64).reshape(-1, k)
                last = min(lo + slice_size, k - 1)
                for at in range(lo, last, 64):
                    first = np.arange(at, min(at + 64, last))
                    i = np.repeat(first, k - 1 - first)
                    j = np.concatenate([np.arange(x + 1, k) for x in first])
                    step = max(1, most // len(i))
                    for r in range(0, len(who), step):
                        s.add(who[r:r + step], p[r:r + step], p0[r:r + step], i, j)
                if s.size > most:
                    s.fold()
                    if s.size > most:
                        yield from s.rows(lang)
        for lang, s in sums.items():
            yield from s.rows(lang)

    dealt = terms_of.where("size(of) > 1").select(
        "lang", F.explode(F.expr(f"sequence(0, size(of) - 2, {slice_size})")).alias("lo"), "of")
    return dealt.mapInArrow(run, PAIRS)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` as in the module's docstring."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    found = materialise(frequencies(rows, least), "divergence-terms")
    marker = GROUP.decode()
    kept = found.where(F.col("term") != marker)
    postings = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select(
        "lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("n"))
    # per group: occurrences and distinct kept terms; per language: the same
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    of_group = postings.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("n_terms"))
    groups = (found.where(F.col("term") == marker).select("lang", F.explode("sources").alias("source"))
              .join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
              .na.fill(0, ["n_group", "n_terms", "v", "n_lang"])
              .withColumn("p0", _share("0", "n_group", "v")))
    groups = materialise(groups, "divergence-groups")

    scored = (postings.join(groups, ["lang", "source"])
              .withColumn("p", _share("n", "n_group", "v")).withColumn("q", _share("total", "n_lang", "v")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_part = (scored.where("p > q").select("lang", "source", F.col("term").alias("item"), _f("p", "q").alias("value"))
                 .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
                 .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))

    # a group's terms against the others' share of absent terms, by count
    levels = (postings.groupBy("lang", "source", "n").agg(F.count("*").alias("times"))
              .join(groups, ["lang", "source"])
              .select("lang", F.col("source").alias("a"), "times", _share("n", "n_group", "v").alias("p"))
              .unionAll(groups.where("v > 0").select("lang", F.col("source").alias("a"),
                                                     F.expr("v - n_terms").alias("times"), F.col("p0").alias("p")))
              .withColumn("salt", F.pmod(F.hash("a", "p"), F.lit(16))))
    others = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q"),
                           F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    one_way = (levels.join(others, ["lang", "salt"]).where("a != b")
               .groupBy("lang", "a", "b").agg(F.sum(F.col("times") * _f("p", "q")).alias("value")))
    both_ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
    absent = (groups.select("lang", "v", F.col("source").alias("a"), F.col("p0").alias("p"))
              .join(groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q")), "lang").where("a != b")
              .select("lang", "a", "b", F.when(F.col("v") > 0, -F.col("v") * _f("p", "q")).otherwise(0).alias("value")))
    shared = scored.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("of"))
    sums = (one_way.unionAll(corrections(shared)).select("lang", both_ways, "value").select("lang", "x.*", "value")
            .unionAll(absent).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pair_part = (sums.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"),
                             F.col("b").alias("item"), "value")
                 .withColumn("rank", F.row_number().over(by_value)))
    report = materialise(pair_part.unionByName(term_part), "divergence")
    discard(found)
    discard(groups)
    return report


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents", "text", "lang", "source"))
