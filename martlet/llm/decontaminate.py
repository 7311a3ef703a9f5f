"""Benchmark decontamination with suffix arrays over the training texts.

Method: the documents of a task form shards. Each shard keeps a suffix array
over its words; every window of every test item is binary-searched in it, which
gives all its locations, and the neighbours of the test suffixes in the joint
order give the longest verbatim matches. Documents with a match of a whole
window are affected.

* Words are compared as numbers in the test set's vocabulary. A document word
  outside it ends a run, as no test suffix goes past it; runs shorter than the
  shortest window cannot hold an occurrence, so their suffixes stay out of the
  array. That is exact and keeps arrays small.
* Suffixes are places in one buffer, sorted by prefix doubling: memory is a few
  numbers per word, however long one item or document is, and equal stretches
  of any length take a logarithmic number of rounds.
* Longest matches are taken among the runs and items that share a window: two
  suffixes' common length follows from the ranks of the doubling rounds.
* Documents never move: one Arrow pass, no shuffle, memory bounded by a shard
  of ``SHARD_WORDS`` words (a longer document is a shard of its own).
* The test set is the stated query set. It is sent to all tasks in blocks of
  at most ``BLOCK_BYTES`` of text, measured before anything is collected; a
  larger set takes more passes, whose hits are united per document row.

Edge cases: NULL, empty or word-less texts have no words and are clean; items
without words match nothing; items with a NULL id count as one item whose id
is left out of the hash; repeated items each count; rows repeat as given; of
equally long matches the first in the text is reported.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, table

WINDOW = 10
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 16 << 20
#: Bytes that belong to words: digits, letters and all of non-ASCII. A-Z are
#: lower-cased, everything else separates.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


def _ranked(first: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of all suffixes of ``first`` (by their first ``depth`` words at
    least, wholly if None) and the ranks after 1, 2, 4 .. words."""
    rank = np.unique(first, return_inverse=True)[1].astype(np.int64)
    levels, step, n = [rank], 1, len(rank)
    while n and rank.max() < n - 1 and (depth is None or step < depth):
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - step)] = rank[step:] + 1          # beyond the end: before everything
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        step *= 2
    return np.argsort(rank, kind="stable"), levels


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and at ``b`` have in common."""
    n, same = len(levels[0]), np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        inside = (x < n) & (y < n)
        equal = inside & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        # ranks are equal for equal words only: separators are all different
        same += np.where(equal, 1 << j, 0)
    return same


def _joined(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts in a row, each ended by a number of its own from ``least`` on, and
    where each begins."""
    starts = np.cumsum([0] + [len(x) + 1 for x in parts])[:-1]
    out = np.empty(sum(len(x) + 1 for x in parts), np.int64)
    for n, (at, x) in enumerate(zip(starts.tolist(), parts)):
        out[at:at + len(x)] = x
        out[at + len(x)] = least + n
    return out, starts


class TestSet:
    """Vocabulary and windows of a block of test items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[object, np.ndarray, int]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.uint32), len(ids)))
        self.shortest = min((min(n, window) for *_, n in self.items), default=0)
        self.widths = np.array([min(n, window) for *_, n in self.items], np.int64)
        data, self.starts = _joined([ids for _, ids, _ in self.items], len(self.vocabulary) + 1)
        self.data = data.astype(">u4").tobytes()
        # places of windows, those of equal words together
        item = np.repeat(np.arange(len(self.items)), [n + 1 for *_, n in self.items]) if self.items else np.zeros(0, np.int64)
        order = _ranked(data, window)[0]
        begins = order - self.starts[item[order]] if self.items else order
        ends = np.array([n for *_, n in self.items], np.int64)
        self.places = order[begins + self.widths[item[order]] <= ends[item[order]]] if self.items else order
        self.item_of = item

    def windows(self):
        """(window as bytes, places with it) of all distinct windows."""
        held: dict[int, tuple[bytes, list[int]]] = {}       # by width: at most one per number of words
        for place in self.places.tolist():
            width = int(self.widths[self.item_of[place]])
            key = self.data[4 * place:4 * (place + width)]
            now = held.get(width)
            if now and now[0] == key:
                now[1].append(place)
            else:
                if now:
                    yield now
                held[width] = (key, [place])
        yield from held.values()


class Shard:
    """Suffix array over the vocabulary runs of some documents."""

    def __init__(self, test: TestSet):
        self.test = test
        self.runs: list[tuple[int, int, np.ndarray]] = []   # document, first word, numbers
        self.words = 0

    def add(self, doc: int, tokens: list[bytes]) -> None:
        self.words += len(tokens)
        get = self.test.vocabulary.get
        ids = np.array([get(w, 0) for w in tokens], np.uint32)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.test.shortest:
                self.runs.append((doc, a, ids[a:b]))

    def search(self):
        """Yield (test places, runs, places in them, width) for each distinct
        test window with a location in the shard."""
        test = self.test
        if not self.runs or not test.items:
            return
        data, starts = _joined([ids for *_, ids in self.runs], len(test.vocabulary) + 1 + len(test.items))
        array = _ranked(data, test.window)[0].tolist()
        buffer, deep = data.astype(">u4").tobytes(), 4 * test.window
        key = lambda place: buffer[4 * place:4 * place + deep]
        for window, places in test.windows():
            lo = bisect_left(array, window, key=key)
            if lo == len(array) or not key(array[lo]).startswith(window):
                continue
            hi = bisect_right(array, window + b"\xff" * 4, lo, key=key)
            found = np.array(array[lo:hi], np.int64)
            runs = np.searchsorted(starts, found, side="right") - 1
            yield places, runs, found - starts[runs], len(window) // 4

    def longest(self, runs: list[int], items: list[int]) -> list[tuple[int, int, int, int, int]]:
        """(run, place in it, item, place in it, words): for each place of some
        runs the longest match with a suffix of some items. It is that with the
        nearest test suffix before or after it in the joint order."""
        test = self.test
        own, from_items = [self.runs[r][2] for r in runs], [test.items[k][1] for k in items]
        data, starts = _joined([*own, *from_items], len(test.vocabulary) + 1)
        order, levels = _ranked(data)
        border = int(starts[len(own)]) if from_items else len(data)
        is_test = order >= border
        at = np.arange(len(order))
        before = np.maximum.accumulate(np.where(is_test, at, -1))
        after = np.minimum.accumulate(np.where(is_test, at, len(order))[::-1])[::-1]
        rows = np.flatnonzero(~is_test)
        best, partner = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for side in (before, after):
            near = side[rows]
            valid = (near >= 0) & (near < len(order))
            to = order[np.where(valid, near, 0)]
            n = np.where(valid, _common(levels, order[rows], to), 0)
            better = n > best
            best, partner = np.where(better, n, best), np.where(better, to, partner)
        keep = best > 0
        place, partner, best = order[rows][keep], partner[keep], best[keep]
        part, other = (np.searchsorted(starts, x, side="right") - 1 for x in (place, partner))
        return list(zip([runs[k] for k in part.tolist()], (place - starts[part]).tolist(),
                        [items[k - len(own)] for k in other.tolist()], (partner - starts[other]).tolist(), best.tolist()))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(m) for m in merged]


def scan(texts: list[str | None], test: TestSet, shard_words: int = SHARD_WORDS):
    """Per text: number of words, merged hit word ranges, item numbers, and the
    longest match as (words, first word) or (0, None)."""
    out: list = [None] * len(texts)
    shard, held = Shard(test), {}

    def flush():
        spans, items = {d: [] for d in held}, {d: set() for d in held}
        top = {d: (0, None) for d in held}
        runs, sources = set(), set()

        def longer(doc: int, n: int, start: int) -> None:
            if n > top[doc][0] or (n == top[doc][0] and start < top[doc][1]):
                top[doc] = n, start

        for places, found, at, width in shard.search():
            numbers = set(test.item_of[places].tolist())
            seen = set()
            for r, p in zip(found.tolist(), at.tolist()):
                doc, first, _ = shard.runs[r]
                spans[doc].append((first + p, first + p + width))
                if doc not in seen:
                    seen.add(doc)
                    items[doc] |= numbers
                longer(doc, width, first + p)
                if width == test.window:
                    runs.add(r)
            if width == test.window:
                sources |= numbers
        if runs:
            for r, p, _, _, n in shard.longest(sorted(runs), sorted(sources)):
                if n >= test.window:
                    longer(shard.runs[r][0], n, shard.runs[r][1] + p)
        for d, n in held.items():
            out[d] = n, _merged(spans[d]), sorted(items[d]), top[d]

    for d, text in enumerate(texts):
        tokens = words(text)
        held[d] = len(tokens)
        shard.add(d, tokens)
        if shard.words >= shard_words:
            flush()
            shard, held = Shard(test), {}
    flush()
    return out


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list[list[tuple]]:
    """The test set in lists of at most ``block_bytes`` (or one item) each."""
    sized = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    total = sized.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= block_bytes:
        return [[tuple(r) for r in sized.collect()]]
    blocks, size = [[]], 0
    for row in sized.toLocalIterator():
        n = len(row.t or "")
        if size + n > block_bytes and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(tuple(row))
        size += n
    return blocks


HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.StructType([T.StructField("words", T.LongType()), T.StructField("start", T.LongType())]))])


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None,
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``n_words``, merged hit word ranges ``hits`` (end
    exclusive), ``items`` (ids of occurring items as text) and the ``longest``
    match (words, start) per row. With more than one block the passes chain,
    each adding to the one before."""
    keep = keep if keep is not None else docs.columns
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes):
        test = docs.sparkSession.sparkContext.broadcast(TestSet(block, window))

        def start(test=test):
            def run(texts, *before):
                got = scan(texts.to_pylist(), test.value)
                names = [None if i is None else str(i) for i, *_ in test.value.items]
                hits = [[{"start": a, "end": b} for a, b in h] for _, h, _, _ in got]
                found = [[names[k] for k in ks] for _, _, ks, _ in got]
                top = [{"words": n, "start": at} for *_, (n, at) in got]
                if before:
                    old_hits, old_items, old_top = (b.to_pylist() for b in before)
                    hits = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in old + new])]
                            for old, new in zip(old_hits, hits)]
                    found = [a + b for a, b in zip(old_items, found)]
                    top = [max(x, y, key=lambda t: (t["words"], -(t["start"] or 0))) for x, y in zip(old_top, top)]
                return [[n for n, *_ in got], hits, found, top]
            return run
        if out is None:
            out = map_columns(docs, [text], list(dict.fromkeys([*keep, text])), HITS, start)
        else:
            out = map_columns(out.withColumnsRenamed({"hits": "hits0", "items": "items0", "longest": "longest0"}).drop("n_words"),
                              [text, "hits0", "items0", "longest0"], list(dict.fromkeys([*keep, text])), HITS, start)
    return out.select(*keep, "n_words", "hits", "items", "longest")


def longest_matches(texts: list[str | None], test: TestSet) -> list[tuple]:
    """(item_id, item word, text number, text word, words matched) for every
    place of the texts at which a whole window of an item begins: the longest
    match there (of several as long, with one of them)."""
    shard = Shard(test)
    for d, text in enumerate(texts):
        shard.add(d, words(text))
    best: dict[tuple[int, int], tuple] = {}
    runs, sources = set(), set()
    for places, found, at, width in shard.search():
        k = int(test.item_of[places[0]])
        for r, p in zip(found.tolist(), at.tolist()):
            now = best.get((r, p))
            if now is None or now[0] < width:
                best[r, p] = width, k, int(places[0] - test.starts[k])
            runs.add(r)
        sources |= set(test.item_of[places].tolist())
    for r, p, k, q, n in shard.longest(sorted(runs), sorted(sources)) if runs else ():
        if (r, p) in best and n > best[r, p][0]:
            best[r, p] = n, k, q
    return [(test.items[k][0], q, shard.runs[r][0], shard.runs[r][1] + p, n) for (r, p), (n, k, q) in best.items()]


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                          table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["doc_id"])
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])
    ids = F.array_join(F.sort_array("items"), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
                        F.col("longest.words").alias("longest_match"), F.col("longest.start").alias("longest_start"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with any hit go."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = contamination(whole, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=["row"])
    return found.where(F.size("hits") == 0).select("row.*")
