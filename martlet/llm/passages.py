"""Near-duplicate passages across documents by compact windows.

Method: a text is its sequence of five-word shingles. The Cartesian tree of the
shingles' hash values groups all subsequences of at least ``BLOCK`` shingles by
the place of their minimum: a node c with bounds l and r stands for every
subsequence from within [l, c] to within [c, r]. Only nodes that span ``BLOCK``
shingles are kept, about two per ``BLOCK`` shingles.

An edit of one word makes nine foreign shingles or more (five and four), so two
passages of ``LEAST`` shingles and a Jaccard similarity of 0.8 have 21 equal
shingles in a row, 19 where the words around edits repeat. Such a block has its
minimum at one place in both, and at least half of it lies up to or from there:
the two passages share a key. That holds for every pair and one hash function;
texts of so few words that similar ones have no such block in common are the
exception.

1. One Arrow pass lists the compact windows. Nodes come from sliding minima,
   bounds from binary lifting over range minima; whole batches of documents are
   handled at once and no window crosses a document.
2. A window has up to two keys: the shingles of half a block up to c, and from
   c on, where the window reaches so far. Windows with one key are joined as a
   star around the key's least window (by document id, then place). Each batch
   ships its least window of a key (and that document's others) alone, so a
   frequent key is one document per batch where keys meet; windows go in blocks
   per key range, column by column in byte planes. Where a batch's window is
   not the least one, the answer goes back to the batch's other windows by an
   equi-join. So every link follows from the table alone, not from its
   partitions.
3. Interval join: links between the same two documents whose surroundings
   (``MARGIN``) overlap on both sides are one candidate.
4. Candidates are verified on the shingles of both regions: blocks of equal
   shingles are aligned, and the longest stretch from block to block with at
   least ``LEAST`` shingles on both sides and a Jaccard similarity of at least
   0.8 is cut out (the densest stretch where blocks cannot be aligned), with
   what follows of shingles that both sides hold already. The similarity of
   each result is exact.
5. A representative may hold the key but not the passage. Windows of a key are
   then compared in cells of bounded size by the shingles around them, but for
   those whose windows lie in passages that verified rows already join
   (components of overlapping passages, or passages found in the cell) or that
   are both similar to the star's representative. Windows whose surroundings
   are similar to none of the others, all taken together, leave first; equal
   passages with repeated shingles (a word said 50 times) are joined as stars;
   a bound on shared shingles, counted for many pairs at once, rules out most
   others before passages are looked for. Whole copies meet others through
   their first.

The result has a row per passage and representative (``doc_id, start_word,
end_word, match_id, match_start, match_end, similarity``; word numbers, end
exclusive). Copies of one passage point at their representative and need not be
expanded into pairs; passages that no representative joins have rows that join them.
All numbers that links depend on are functions of one document, so results do
not depend on how rows are dealt out.

The counting of step 5 grows with the square of the windows of one key that
could be similar to some other but have no passage in common with it; that is
the price of leaving out no pair.

Edge cases: NULL, empty and short texts have no windows; rows without a doc_id
cannot be named in a result and are left out; rows with one id are one
document; passages repeated inside one document only are not reported; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, ship, table
from .simhash import components

SHINGLE = 5
LEAST = 46           # shingles: 50 words
HASHES = 5
BLOCK = 19           # shingles in a row that similar passages share
MARGIN = LEAST + BLOCK + 2 * SHINGLE  # a passage reaches so far from a place in its blocks
NEAR = 128           # windows of a key so near are compared as one
CELL = 1024          # windows of a key whose surroundings are counted against as many
SIMILARITY = 0.8
CHUNK = 500_000      # shingles handled at once (a longer text is a chunk of its own)
_SEEDS = [np.uint64(xxhash.xxh64_intdigest(b"window", i)) for i in range(HASHES)]
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POSITION = (1 << 40) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hash of every five consecutive words (none for shorter texts)."""
    words = text.encode().lower().split() if text else []
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = w[:n].copy()
    for k in range(1, SHINGLE):
        out = out * _PRIME + w[k:k + n]
    return _mixed(out)


def _range_minima(order: np.ndarray, longest: int) -> list[np.ndarray]:
    """minima[j][p] = least of order[p : p + 2**j]."""
    levels = [order]
    while 2 ** len(levels) <= min(longest, len(order)):
        half, last = 2 ** (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def compact_windows(sequences: list[np.ndarray], least: int = LEAST, functions: int = HASHES):
    """Arrays (sequence, function, l, c, r, signature, halves) of all compact
    windows that span at least ``least`` shingles; halves has two columns, the
    keys up to c and from c on, 0 where the window ends before."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    longest = int(sizes.max(initial=0))
    if longest < least:
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)]
    # one border before each sequence and one at the end; borders order first
    first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
    n = int(sizes.sum() + len(sizes) + 1)
    values = np.zeros(n, np.uint64)
    border = np.ones(n, bool)
    for at, s in zip(first.tolist(), sequences):
        values[at:at + len(s)] = s
        border[at:at + len(s)] = False
    # the same for all chunks of usual size, so that ties do not depend on them
    bits = np.uint64(max(24, n.bit_length()))
    place = np.arange(n, dtype=np.uint64)
    mask = np.uint64((1 << int(bits)) - 1)
    half = least // 2 + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(values))))
    tops = []
    for seed in _SEEDS[:functions]:
        order = (_mixed(values + seed) >> bits << bits) | place
        order[border] = 0
        tops.append(order)
    found = []
    for i, order in enumerate(tops):
        levels = _range_minima(order, longest)
        j = int(np.log2(least))
        span = n - least + 1
        least_of = np.minimum(levels[j][:span], levels[j][least - 2 ** j:least - 2 ** j + span])
        least_of = least_of[least_of > 0]
        if not len(least_of):
            continue
        c = (least_of[np.concatenate(([True], least_of[1:] != least_of[:-1]))] & mask).astype(np.int64)
        own = order[c]
        l, r = c.copy(), c.copy()  # noqa: E741
        for j in range(len(levels) - 1, -1, -1):
            level, step = levels[j], 2 ** j
            ahead = np.minimum(r + 1, len(level) - 1)
            r += step * ((r + 1 < len(level)) & (level[ahead] > own))
            before = np.maximum(l - step, 0)
            l -= step * ((l >= step) & (before < len(level)) & (level[np.minimum(before, len(level) - 1)] > own))  # noqa: E741
        sig = _mixed(values[c] + _SEEDS[i])
        before, after = c - l + 1 >= half, r - c + 1 >= half
        halves = np.zeros((len(c), 2), np.uint64)
        halves[before, 0] = _mixed(sig[before] + _mixed(sums[c[before] + 1] - sums[c[before] + 1 - half]))
        halves[after, 1] = _mixed(sig[after] - _mixed(sums[c[after] + half] - sums[c[after]]))
        seq = np.searchsorted(first, c, side="right") - 1
        found.append((seq, np.full(len(c), i), l - first[seq], c - first[seq], r - first[seq], sig, halves))
    if not found:
        return [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)]
    return [np.concatenate(x) for x in zip(*found)]


def star(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: which are the first of their key, and the row
    that each row is linked to (its own for firsts)."""
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    return new_key, np.maximum.accumulate(np.where(new_key, np.arange(len(key)), 0))


#: A window: document, bounds (l << 32 | r) and place (side << 40 | c); the side
#: is 0 where the key goes up to c, 1 where it goes on from c.
_WINDOW = [T.StructField("doc", T.LongType()), T.StructField("lr", T.LongType()), T.StructField("at", T.LongType())]
#: A batch's windows of one key range, or (range below 0) links inside a batch.
BLOCKS = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("batch", T.LongType()),
                       T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: Links; ``ask`` marks those of a batch's own window, and the answers to it,
#: which have no ``b``.
LINKS = T.StructType([T.StructField("ask", T.LongType())]
                     + [T.StructField(f"{s}_{f.name}", T.LongType()) for s in "ab" for f in _WINDOW])
_KEYED = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint8)   # key, doc, l, c - l, r - c, side, asks
_INSIDE = (np.uint64,) + 2 * (np.int64, np.uint32, np.uint32, np.uint32, np.uint8)    # ask and two windows
ROWS_OF_BLOCK = 1 << 15


def _pack(columns: list[np.ndarray], types) -> bytes:
    """Columns as byte planes: high bytes of small numbers lie together."""
    return b"".join(np.ascontiguousarray(c.astype(t, copy=False)).view(np.uint8).reshape(len(c), -1).T.tobytes()
                    for c, t in zip(columns, types))


def _unpack(data: bytes, n: int, types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        size = np.dtype(t).itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * size
    return out


def _spans(lr: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """l, c - l, r - c and side of windows."""
    l, r, c = lr >> 32, lr & 0xFFFFFFFF, at & _POSITION  # noqa: E741
    return [l, c - l, r - c, at >> 40]


def _window(doc, l, left, right, side) -> list[np.ndarray]:  # noqa: E741
    """doc, lr and at from the columns of a block."""
    l, c, r = l.astype(np.int64), l.astype(np.int64) + left, l.astype(np.int64) + left + right  # noqa: E741
    return [doc, l << 32 | r, side.astype(np.int64) << 40 | c]


def _list_windows(ranges: int):
    """Blocks of a batch's least window per key, and of links inside it."""
    def run(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            parts, chunk, held, begin = [], [], 0, 0

            def flush(end):
                seq, _, _, c, _, sig, halves = compact_windows(chunk, BLOCK, 1)
                parts.append((sig, halves, ids[begin + seq], c << 32 | c, c))

            for k, text in enumerate(batch.column("text")):
                s = shingles(text.as_py())
                s = s if len(s) >= LEAST else s[:0]
                if chunk and len(s) >= CHUNK:              # a chunk of its own
                    flush(k)
                    chunk, held, begin = [], 0, k
                chunk.append(s)
                held += len(s)
                if held >= CHUNK:
                    flush(k + 1)
                    chunk, held, begin = [], 0, k + 1
            if chunk:
                flush(batch.num_rows)
            parts = [p for p in parts if len(p[0])]
            if not parts:
                continue
            sig, halves, doc, lr, at = (np.concatenate(x) for x in zip(*parts))
            del parts
            order = np.lexsort((at, lr, doc))
            sig, halves, doc, lr, at = (x[order] for x in (sig, halves, doc, lr, at))
            # a batch's number follows from what is in it
            batch_id = _mixed(np.array([np.bitwise_xor.reduce(_mixed(sig + doc.view(np.uint64) + at.view(np.uint64)))]))
            for side in range(2):
                key, raised = halves[:, side], side << 40
                rows = np.flatnonzero(key)
                rows = rows[np.argsort(key[rows], kind="stable")]      # by key, document and place
                firsts, to = star(key[rows]) if len(rows) else (np.zeros(0, bool), rows)
                # the least window goes where keys meet, and its own document's
                # other windows with it; other documents' are linked here
                again = doc[rows] == doc[rows[to]]
                others = np.flatnonzero(~again)
                asks = np.zeros(len(rows), np.uint8)
                asks[to[others]] = 1
                if len(others):
                    x, f = rows[others], rows[to[others]]
                    ask = _mixed(key[x] ^ batch_id)
                    inside = [ask, doc[f], *_spans(lr[f], at[f] + raised), doc[x], *_spans(lr[x], at[x] + raised)]
                    for n in range(0, len(x), ROWS_OF_BLOCK):
                        some = [c[n:n + ROWS_OF_BLOCK] for c in inside]
                        yield -1 - int(some[0][0] % np.uint64(ranges)), batch_id, len(some[0]), _pack(some, _INSIDE)
                pick = rows[again]
                columns = [key[pick], doc[pick], *_spans(lr[pick], at[pick] + raised), asks[again]]
                which = (key[pick] % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(ranges + 1))
                columns = [c[order] for c in columns]
                for k in range(ranges):
                    a, b = edges[k], edges[k + 1]
                    if b > a:
                        yield k, batch_id, int(b - a), _pack([c[a:b] for c in columns], _KEYED)

    def rows(batches):
        held, size = [], 0
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for k, batch_id, n, data in run(batches):
            held.append((k, int(batch_id.view(np.int64)[0]), n, data))
            size += len(data)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], BLOCKS.fieldNames())
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], BLOCKS.fieldNames())
    return rows


def _links(ask, a, b) -> pa.RecordBatch:
    n = len(a[0])
    empty = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x).astype(np.int64, copy=False))
    return pa.RecordBatch.from_arrays([empty(ask), *map(empty, a), *map(empty, b or (None, None, None))], LINKS.fieldNames())


def _join_windows(batches):
    """Star links of the blocks of each key range, answers to the batches whose
    window is not the key's least, and the links inside batches as they are."""
    def whole(blocks):
        parts = [_unpack(data, n, _KEYED) for _, n, data in blocks]
        key, doc, l, left, right, side, asks = (np.concatenate(x) for x in zip(*parts))  # noqa: E741
        batch = np.repeat(np.array([b for b, _, _ in blocks], np.int64).view(np.uint64), [n for _, n, _ in blocks])
        _, count = np.unique(key, return_counts=True)
        if (count == 1).all():
            return
        doc, lr, at = _window(doc, l, left, right, side)
        order = np.lexsort((at, lr, doc, key))
        key, doc, lr, at, asks, batch = (x[order] for x in (key, doc, lr, at, asks, batch))
        _, to = star(key)
        moved = np.flatnonzero((to != np.arange(len(to))) & ((doc != doc[to]) | (asks > 0)))
        for n in range(0, len(moved), 1 << 15):
            x = moved[n:n + (1 << 15)]
            m = to[x]
            apart = doc[x] != doc[m]
            yield _links(None, (doc[m][apart], lr[m][apart], at[m][apart]), (doc[x][apart], lr[x][apart], at[x][apart]))
            asking = asks[x] > 0
            if asking.any():
                x, m = x[asking], m[asking]
                yield _links(_mixed(key[x] ^ batch[x]).view(np.int64), (doc[m], lr[m], at[m]), None)

    now, blocks = None, []
    for part in batches:
        for k, batch_id, n, data in zip(*(part.column(c).to_pylist() for c in BLOCKS.fieldNames())):
            if k < 0:
                ask, *windows = _unpack(data, n, _INSIDE)
                yield _links(ask.view(np.int64), _window(*windows[:5]), _window(*windows[5:]))
                continue
            if k != now and blocks:
                yield from whole(blocks)
                blocks = []
            now = k
            blocks.append((batch_id, n, data))
    if blocks:
        yield from whole(blocks)


def window_links(docs: DataFrame) -> DataFrame:
    """Links between the windows of different documents: each window with the
    least one of its key (columns of ``LINKS`` but ``ask``)."""
    spark = docs.sparkSession
    ship(spark)
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = docs.mapInArrow(_list_windows(8 * width), BLOCKS)
    found = materialise(blocks.repartition(width, "range").sortWithinPartitions("range")
                        .mapInArrow(_join_windows, LINKS), "passage-links")
    ends = ["a_doc", "a_lr", "a_at", "b_doc", "b_lr", "b_at"]
    answers = (found.where("b_doc IS NULL").dropDuplicates(["ask"])
               .select(F.col("ask").alias("asked"), *[F.col(f"a_{x}").alias(f"m_{x}") for x in ("doc", "lr", "at")]))
    inside = (found.where("b_doc IS NOT NULL AND ask IS NOT NULL").join(answers, F.col("ask") == F.col("asked"), "left")
              .select(*[F.coalesce(f"m_{x}", f"a_{x}").alias(f"a_{x}") for x in ("doc", "lr", "at")], *ends[3:]))
    return found.where("ask IS NULL").select(*ends).unionByName(inside).where("a_doc != b_doc")


def regions(rows: list[tuple], least: int = LEAST) -> list[dict]:
    """Interval join of the links of one document pair, sorted rows of (c, c of
    b, l, r, l and r of b): hulls of links that overlap on both sides."""
    open_, done = [], []
    for ca, cb, la, ra, lb, rb in rows:
        for h in open_:
            if la <= h["a_to"] and lb <= h["b_to"] and rb >= h["b_from"] and abs((ca - cb) - h["shift"]) <= least:
                h.update(a_from=min(h["a_from"], la), a_to=max(h["a_to"], ra), b_from=min(h["b_from"], lb),
                         b_to=max(h["b_to"], rb), shift=ca - cb)
                break
        else:
            still = [h for h in open_ if h["a_to"] >= la]
            done += [h for h in open_ if h["a_to"] < la]
            open_ = still + [{"a_from": la, "a_to": ra, "b_from": lb, "b_to": rb, "shift": ca - cb}]
    return [{k: h[k] for k in ("a_from", "a_to", "b_from", "b_to")} for h in done + open_]


def _densest(member: np.ndarray, cost: int) -> tuple[int, int]:
    """Stretch with the largest sum of +1 for members and -cost for others."""
    sums = np.concatenate(([0], np.cumsum(np.where(member, 1, -cost))))
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.flatnonzero(sums[:end + 1] == low[end])[0]) if end else 0, end


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both arrays with their values numbered from 0 on, and the count of numbers."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    value = both[order]
    number = np.cumsum(value[1:] != value[:-1])
    out = np.zeros(len(both), np.int64)
    out[order[1:]] = number
    return out[:len(a)], out[len(a):], int(number[-1]) + 1 if len(number) else len(both)


def _held(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[x] = True
    return out


def _paired(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each place of a the place of the same occurrence of its number in b,
    -1 where there is none."""
    in_a, in_b = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
    if in_a.max() < 2 and in_b.max() < 2:
        to = np.full(n, -1)
        to[b] = np.arange(len(b))
        return to[a]
    order = np.argsort(np.concatenate((a, b)), kind="stable")    # those of a before those of b
    first = np.cumsum(in_a + in_b) - in_a - in_b
    at = np.flatnonzero(order < len(a))
    place = order[at]
    number = a[place]
    nth = at - first[number]
    some = nth < in_b[number]
    to = np.full(len(a), -1)
    to[place[some]] = order[(first[number] + in_a[number] + nth)[some]] - len(a)
    return to


def _chain(start: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows of the heaviest chain of blocks whose starts increase."""
    if (start[1:] > start[:-1]).all():
        return np.arange(len(start))
    tops, rows, back = [], [], []       # increasing starts, each with a larger weight than the one before
    heavy = []
    for k, (at, w) in enumerate(zip(start.tolist(), weight.tolist())):
        i = bisect.bisect_left(tops, at)
        back.append(rows[i - 1] if i else -1)
        w += heavy[i - 1] if i else 0
        j = i
        while j < len(tops) and heavy[j] <= w:
            j += 1
        if j > i or i == len(tops) or tops[i] > at:
            tops[i:j], rows[i:j], heavy[i:j] = [at], [k], [w]
    k, out = rows[-1], []
    while k >= 0:
        out.append(k)
        k = back[k]
    return np.array(out[::-1])


def _aligned(a: np.ndarray, b: np.ndarray, n: int, least: int, similarity: float):
    """(a from, a to, b from, b to) of the longest stretch whose aligned blocks
    of equal shingles reach the similarity, or None; shingles are numbers
    under n.

    Shingles are paired by value and occurrence. A stretch from block i to
    block j with s shared shingles and f others on both sides together has the
    similarity s / (s + f). A stretch of under ``least`` shingles is filled up
    with its neighbours."""
    to = _paired(a, b, n)
    shared = np.flatnonzero(to >= 0)
    if not len(shared):
        return None
    to = to[shared]
    new = np.concatenate(([True], (np.diff(shared) != 1) | (np.diff(to) != 1)))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(shared)))
    chain = _chain(to[at], size)
    x, p, size = shared[at][chain], to[at][chain], size[chain]
    overlap = np.maximum(0, np.concatenate(([0], p[:-1] + size[:-1] - p[1:])))      # blocks of b that run into the next
    x, p, size = x + overlap, p + overlap, size - overlap
    keep = size > 0
    x, p, size = x[keep], p[keep], size[keep]
    others = np.concatenate(([0], (x[1:] - x[:-1] - size[:-1]) + (p[1:] - p[:-1] - size[:-1])))
    cost = similarity / (1 - similarity)
    before = np.cumsum(size) - size - cost * np.cumsum(others)
    after = before + size
    low = np.minimum.accumulate(before)
    i = np.searchsorted(-low, -after - 1e-6)          # the first block from which the sum stays at 0 or more
    spans = np.minimum(x + size - x[i], p + size - p[i])
    j = int(np.argmax(spans))
    if spans[j] >= least:
        return int(x[i[j]]), int(x[j] + size[j]), int(p[i[j]]), int(p[j] + size[j])
    # too short from block to block, as where the first or last words differ:
    # with other shingles up to the least length it can still be similar
    i, d = np.arange(len(x)), np.arange(min(len(x), int(least * (1 - similarity)) + 1))[:, None]
    j = np.minimum(i + d, len(x) - 1)                 # block i and d further ones
    pad_a, pad_b = (np.maximum(0, least - ((v + size)[j] - v)) for v in (x, p))
    equal = np.cumsum(size)[j] - np.cumsum(size) + size
    foreign = np.cumsum(others)[j] - np.cumsum(others) + pad_a + pad_b
    rate = np.where(i + d < len(x), equal / (equal + foreign), 0)
    k = int(np.argmax(rate))
    best, found = float(rate.flat[k]), (k % len(x), k % len(x) + k // len(x))
    if best < similarity - 1e-9 or min(len(a), len(b)) < least:
        return None
    i, j = found
    left = min(int(max(least - (x[j] + size[j] - x[i]), least - (p[j] + size[j] - p[i]), 0)), int(x[i]), int(p[i]))
    out = []
    for v, whole in ((x, len(a)), (p, len(b))):
        begin, end = int(v[i]), int(v[j] + size[j])
        begin -= min(left, max(0, least - (end - begin)))
        end = min(whole, max(end, begin + least))
        out += [min(begin, max(0, end - least)), end]
    return tuple(out)


def _before(x: np.ndarray) -> np.ndarray:
    """The place where each element came last before, -1 where it is new."""
    order = np.argsort(x, kind="stable")
    out = np.full(len(x), -1, np.int64)
    value = x[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    if len(same):
        out[order[same + 1]] = order[same]
    return out


def _density(before: np.ndarray, member: np.ndarray, first: int, last: int, least: int = LEAST,
             similarity: float = SIMILARITY, cost: float | None = None) -> float:
    """The most that a stretch of ``least`` places or more which reaches into
    [first, last] has in different members, each other shingle counting against
    eight (at 0.8). Two stretches share no more than the mean of their members,
    and four times their other shingles at least if they are similar: then both
    have 0 or more together. A shingle said on and on counts once, so that
    stretches go from the start of such a run to the end of one; texts of very
    many runs with repeated shingles are not judged."""
    n = len(member)
    if n < least:
        return -np.inf
    weight = np.where(member, 1, -(2 * similarity / (1 - similarity) if cost is None else cost))
    if (before < 0).all():
        low, sums = np.zeros(n + 1), np.zeros(n + 1)
        np.cumsum(weight, out=sums[1:])
        np.minimum.accumulate(sums, out=low)
        end = np.arange(max(least, first + 1), n + 1)
        return float((sums[end] - low[np.minimum(end - least, last)]).max(initial=-np.inf)) + 1e-6
    run = np.flatnonzero(np.append(True, before[1:] != np.arange(n - 1)))
    if len(run) > 300:
        return np.inf
    end = np.append(run[1:], n)
    start = run[run <= min(n - least, last)][:, None]
    sums = np.cumsum(np.where((run >= start) & (before[run] < start), weight[run], 0), axis=1)
    return float(sums[end >= np.maximum(start + least, first + 1)].max(initial=-np.inf)) + 1e-6


def _jaccard(a: np.ndarray, b: np.ndarray, n: int) -> float:
    left, right = _held(a, n), _held(b, n)
    return int(np.count_nonzero(left & right)) / int(np.count_nonzero(left | right))


def _extended(a: np.ndarray, b: np.ndarray, lo: int, hi: int, found: tuple) -> tuple:
    """A match with the shingles before and after it that both of its sides
    hold already, as where a word goes on: its similarity is the same."""
    x, y, p, q, j = found
    both = set(a[x:y].tolist()).intersection(b[p:q].tolist())

    def ends(values, begin, end, first, last):
        while begin > first and int(values[begin - 1]) in both:
            begin -= 1
        while end < last and int(values[end]) in both:
            end += 1
        return begin, end
    return (*ends(a, x, y, lo, hi), *ends(b, p, q, 0, len(b)), j)


def verify(a: np.ndarray, b: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY):
    """(a from, a to, b from, b to, Jaccard) of matching stretches of two
    shingle arrays; ends exclusive. First the longest aligned stretch that is
    similar as a whole; where there is none, the densest ones."""
    a, b, n = _numbered(a, b)
    held_a, held_b = _held(a, n), _held(b, n)
    member = held_b[a]
    if np.count_nonzero(member) < int(least * similarity):     # no stretch can be similar
        return []
    places = lambda x, held: _before(x) if np.count_nonzero(held) < len(x) else np.full(len(x), -1)
    other = None

    def ruled_out(lo, hi):
        nonlocal other
        if other is None:
            other = _density(places(b, held_b), held_a[b], 0, len(b), least, similarity)
        before = places(a[lo:hi], held_a if hi - lo == len(a) else _held(a[lo:hi], n))
        return _density(before, member[lo:hi], 0, hi - lo, least, similarity) + other < 0

    out, todo = [], [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        part = a[lo:hi]
        if hi - lo < least or out and ruled_out(lo, hi):          # the whole is mostly similar
            continue
        best = None
        whole = _aligned(part, b, n, least, similarity)
        if whole:
            x, y, p, q = lo + whole[0], lo + whole[1], *whole[2:]
            j = _jaccard(a[x:y], b[p:q], n)
            if j >= similarity:
                best = (x, y, p, q, j)
        for cost in () if best or not out and ruled_out(lo, hi) else (4, 9):
            x, y = _densest(member[lo:hi], cost)
            if y - x < least:
                continue
            x, y = lo + x, lo + y
            p, q = _densest(_held(a[x:y], n)[b], cost)
            if q - p < least:
                continue
            j = _jaccard(a[x:y], b[p:q], n)
            if j >= similarity:
                best = (x, y, p, q, j)
                break
        if best:
            best = _extended(a, b, lo, hi, best)
            out.append(best)
            todo += [(lo, best[0]), (best[1], hi)]
    return out


REGIONS = T.StructType([T.StructField("regions", T.ArrayType(T.StructType([
    T.StructField(k, T.LongType()) for k in ("a_from", "a_to", "b_from", "b_to")])))])
FOUND = T.StructType([T.StructField("found", T.ArrayType(T.StructType([
    *[T.StructField(k, T.LongType()) for k in ("match_start", "match_end", "start_word", "end_word")],
    T.StructField("similarity", T.DoubleType())])))])


def _start_regions():
    def run(links):
        sizes = links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = links.flatten()
        a_lr, a_at, b_lr, b_at = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        pair = np.repeat(np.arange(len(sizes)), sizes)
        wider = lambda lr: [np.maximum((lr >> 32) - MARGIN, 0), (lr & 0xFFFFFFFF) + MARGIN]
        columns = [a_at & _POSITION, b_at & _POSITION, *wider(a_lr), *wider(b_lr)]
        order = np.lexsort((*columns[::-1], pair))
        pair, columns = pair[order], [c[order] for c in columns]
        new = np.ones(len(pair), bool)
        if len(pair):                                 # a window may be linked on both sides
            new[1:] = np.any([x[1:] != x[:-1] for x in (pair, *columns)], axis=0)
        rows = list(zip(*(c[new].tolist() for c in columns)))
        ends = np.cumsum(np.bincount(pair[new], minlength=len(sizes))).tolist()
        return [[regions(rows[x:y]) for x, y in zip([0, *ends], ends)]]
    return run


def _start_shingles():
    return lambda texts: [pa.array([(shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                                    for t in texts.to_pylist()], pa.list_(pa.int32()))]


def _start_verify():
    def run(left, right, a_from, b_from):
        out = []
        for a, b, x, y in zip(left, right, a_from.to_pylist(), b_from.to_pylist()):
            a, b = (v.values.to_numpy(zero_copy_only=False) for v in (a, b))
            out.append([{"match_start": x + p, "match_end": x + q + SHINGLE - 1, "start_word": y + r,
                         "end_word": y + s + SHINGLE - 1, "similarity": j} for p, q, r, s, j in verify(a, b)])
        return [out]
    return run


def _by_pair(links: DataFrame) -> DataFrame:
    return links.groupBy("a_doc", "b_doc").agg(F.collect_list(F.struct("a_lr", "a_at", "b_lr", "b_at")).alias("links"))


def _candidates(pairs: DataFrame) -> DataFrame:
    return (map_columns(pairs, ["links"], ["a_doc", "b_doc"], REGIONS, _start_regions)
            .select("a_doc", "b_doc", F.explode("regions").alias("h")).select("a_doc", "b_doc", "h.*"))


def _matches(candidates: DataFrame, content: DataFrame) -> DataFrame:
    """Verified passages of candidates."""
    cut = lambda side: F.slice("s", (F.col(f"{side}_from") + 1).cast("int"),
                               (F.col(f"{side}_to") - F.col(f"{side}_from") + 1).cast("int"))
    with_a = (candidates.join(content.withColumnRenamed("doc", "c_doc"), F.col("a_doc") == F.col("c_doc"))
              .select(*candidates.columns, cut("a").alias("left")))
    with_b = (with_a.join(content.withColumnRenamed("doc", "c_doc"), F.col("b_doc") == F.col("c_doc"))
              .select("a_doc", "b_doc", "a_from", "b_from", "left", cut("b").alias("right")))
    checked = map_columns(with_b, ["left", "right", "a_from", "b_from"], ["a_doc", "b_doc"], FOUND, _start_verify)
    return checked.select("a_doc", "b_doc", F.explode("found").alias("f")).select("a_doc", "b_doc", "f.*")


def _stars(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The windows of each star (g_doc, g_at: its representative's), settled
    where a passage similar to the representative's covers both places."""
    matches = found.groupBy("a_doc", "b_doc").agg(
        F.collect_list(F.struct("match_start", "match_end", "start_word", "end_word")).alias("found"))
    return (pairs.join(matches, ["a_doc", "b_doc"], "left").select("a_doc", "b_doc", "found", F.explode("links").alias("x"))
            .select(F.col("a_doc").alias("g_doc"), F.col("x.a_at").alias("g_at"), F.col("b_doc").alias("doc"),
                    F.col("x.b_lr").alias("lr"), F.col("x.b_at").alias("at"), F.expr(f"""
        coalesce(exists(found, f -> x.a_at & {_POSITION} BETWEEN f.match_start AND f.match_end - {SHINGLE}
                                AND x.b_at & {_POSITION} BETWEEN f.start_word AND f.end_word - {SHINGLE}), false)""").alias("settled")))


def _classes(found: DataFrame) -> DataFrame:
    """Passages of each document that verified rows name, those that overlap by
    half a passage as one, with the root of all that are linked to them."""
    side = lambda doc, start, end: found.select(F.col(doc).alias("doc"), F.col(start).alias("start"), F.col(end).alias("end"))
    spans = side("a_doc", "match_start", "match_end").unionByName(side("b_doc", "start_word", "end_word")).distinct()
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (spans.withColumn("new", F.coalesce((F.col("start") + LEAST // 2 > before).cast("int"), F.lit(1)))
             .withColumn("node", F.xxhash64("doc", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))))
    spans = materialise(spans.drop("new"), "passage-spans")
    ends = [spans.select(F.col("doc").alias(doc), F.col("start").alias(start), F.col("end").alias(end), F.col("node").alias(name))
            for name, doc, start, end in (("a", "a_doc", "match_start", "match_end"), ("b", "b_doc", "start_word", "end_word"))]
    edges = found.join(ends[0], ends[0].columns[:3]).join(ends[1], ends[1].columns[:3]).select("a", "b")
    return (spans.groupBy("doc", "node").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .join(components(edges), "node").select("doc", "start", "end", "root"))


def _placed(windows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per key, document, part of it and class of the passages around
    its windows; those without a passage are a class of their own."""
    passages = classes.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "root")).alias("held"))
    hull = F.shiftleft(F.min(F.shiftright("lr", 32)), 32).bitwiseOR(F.max(F.col("lr").bitwiseAND(F.lit(0xFFFFFFFF))))
    return (windows.withColumn("part", F.floor(F.shiftright("lr", 32) / NEAR))
            .join(passages, ["doc"], "left").withColumn("class", F.expr(f"""
        coalesce(array_min(transform(filter(held, h -> at & {_POSITION} BETWEEN h.start AND h.end - {SHINGLE}), h -> h.root)),
                 xxhash64(doc, g_doc, g_at, part))"""))
            .groupBy("g_doc", "g_at", "doc", "class", "part").agg(hull.alias("lr"), F.min("at").alias("at"), F.min("settled").alias("settled"))
            .select("g_doc", "g_at", "doc", "class", "lr", "at", "settled"))


def _fewest(before: np.ndarray, place: int, last: int) -> int:
    """So many different shingles the poorest stretch of ``LEAST`` places has
    that reaches into [place, last]."""
    begin, end = max(0, place - LEAST + 1), min(last, len(before) - LEAST)
    places = before[begin:end + LEAST]
    if (places < begin).all():
        return LEAST
    places = np.lib.stride_tricks.sliding_window_view(places, LEAST)
    return int((places < np.arange(begin, end + 1)[:, None]).sum(axis=1).min())


def _shared_counts(holds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many shingles some rows of an incidence matrix share with each row."""
    shared = np.zeros((len(rows), len(holds)), np.float32)
    for low in range(0, holds.shape[1], 4096):
        part = holds[:, low:low + 4096].astype(np.float32)
        shared += part[rows] @ part.T
    return shared


class _Surroundings:
    """The surroundings of a cell's windows side by side: numbers of their
    shingles (0 for those that one row alone holds), which row holds which, and
    where stretches that reach into a row's windows may end."""

    def __init__(self, contexts: list[np.ndarray], before: list[np.ndarray], place: np.ndarray, last: np.ndarray):
        self.before, self.place, self.last = before, place, last
        self.size = np.array([len(x) for x in contexts])
        self.plain = np.array([bool((x < 0).all()) for x in before])       # no shingle twice
        row = np.repeat(np.arange(len(contexts)), self.size)
        value = np.unique(np.concatenate(contexts), return_inverse=True)[1]
        new = np.concatenate(before) < 0
        number = np.cumsum(np.bincount(value[new]) > 1)
        number = np.where(np.bincount(value[new]) > 1, number, 0)[value]
        self.holds = np.zeros((len(contexts), int(number.max()) + 1), bool)
        self.holds[row, number] = True
        self.holds[:, 0] = False
        width = int(self.size.max())
        at = np.arange(width)
        self.number = np.zeros((len(contexts), width), np.int32)
        self.number[at < self.size[:, None]] = number
        self.end = np.arange(LEAST, width + 1)
        self.open = (self.end <= self.size[:, None]) & (self.end > place[:, None])
        self.start = np.minimum(self.end - LEAST, last[:, None])

    def member(self, rows: np.ndarray, by: np.ndarray) -> np.ndarray:
        return self.holds[by[:, None], self.number[rows]]

    def densities(self, rows: np.ndarray, member: np.ndarray, cost: float) -> np.ndarray:
        """``_density`` of rows without repeated shingles, each with its members."""
        sums = np.zeros((len(rows), member.shape[1] + 1), np.float32)
        np.cumsum(np.where(member, np.float32(1), np.float32(-cost)), axis=1, out=sums[:, 1:])
        low = np.take_along_axis(np.minimum.accumulate(sums, axis=1), self.start[rows], axis=1)
        return np.where(self.open[rows], sums[:, LEAST:] - low, -np.inf).max(axis=1, initial=-np.inf) + 1e-3

    def density(self, row: int, member: np.ndarray, cost: float) -> float:
        if self.plain[row]:
            return float(self.densities(np.array([row]), member[None], cost)[0])
        return _density(self.before[row], member[:self.size[row]], self.place[row], self.last[row], cost=cost)

    def alone(self, rows: np.ndarray) -> np.ndarray:
        """Which rows are similar to no other: a passage's other shingles count
        four times at most what it shares with all others together."""
        cost = SIMILARITY / (1 - SIMILARITY)
        out, plain = np.zeros(len(rows), bool), np.flatnonzero(self.plain[rows])
        for k in range(0, len(plain), 512):
            some = rows[plain[k:k + 512]]
            out[plain[k:k + 512]] = self.densities(some, self.number[some] > 0, cost) < 0
        for k in np.flatnonzero(~self.plain[rows]).tolist():
            out[k] = self.density(rows[k], self.number[rows[k]] > 0, cost) < 0
        return out

    def possible(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs of rows, that share so many shingles at ``most``, may be
        similar around their windows; True where that is not told for many at
        once."""
        cost, out = 2 * SIMILARITY / (1 - SIMILARITY), np.ones(len(a), bool)
        told = np.flatnonzero(self.plain[a] & self.plain[b])
        for k in range(0, len(told), 1024):
            some = told[k:k + 1024]
            x, y = a[some], b[some]
            one = self.densities(x, self.member(x, y), cost)
            may = one + most[some] >= 0               # no side has more than all that is shared
            x, y = x[may], y[may]
            may[may] = one[may] + self.densities(y, self.member(y, x), cost) >= 0
            out[some] = may
        return out

    def pair_possible(self, x: int, y: int) -> bool:
        if self.plain[x] and self.plain[y]:
            return True                               # told before
        cost = 2 * SIMILARITY / (1 - SIMILARITY)
        return (self.density(x, self.holds[y, self.number[x]], cost) + self.density(y, self.holds[x, self.number[y]], cost)) >= 0


def _equal_stretches(around: _Surroundings, contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, whole) of rows with repeated shingles that have stretches of
    ``LEAST`` places with the same set of shingles, a star for each set; whole
    where such stretches hold all windows of both. Those come first."""
    rows, starts, sums = [], [], []
    for k in np.flatnonzero(~around.plain).tolist():
        begin, end = max(0, int(around.place[k]) - LEAST + 1), min(int(around.last[k]), int(around.size[k]) - LEAST)
        if end < begin:
            continue
        at = np.arange(begin, end + 1)
        views = [np.lib.stride_tricks.sliding_window_view(x[begin:end + LEAST], LEAST)
                 for x in (_mixed(contexts[k].astype(np.uint64)), around.before[k])]
        rows.append(np.full(len(at), k))
        starts.append(at)
        sums.append(np.where(views[1] < at[:, None], views[0], np.uint64(0)).sum(axis=1))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    rows, starts, sums = (np.concatenate(x) for x in (rows, starts, sums))
    order = np.lexsort((starts, rows, sums))
    rows, starts, sums = (x[order] for x in (rows, starts, sums))
    new = np.flatnonzero(np.append(True, (sums[1:] != sums[:-1]) | (rows[1:] != rows[:-1])))
    final = np.append(new[1:], len(rows)) - 1
    row, sums = rows[new], sums[new]
    whole = (starts[new] <= around.place[row]) & (starts[final] + LEAST > around.last[row])
    order = np.lexsort((row, ~whole, sums))
    row, sums, whole = row[order], sums[order], whole[order]
    _, to = star(sums)
    more = np.flatnonzero(to != np.arange(len(to)))
    a, b, whole = row[to[more]], row[more], whole[more] & whole[to[more]]
    order = np.argsort(~whole, kind="stable")
    return a[order], b[order], whole[order]


def _cell_pairs(doc, of, settled, block, place, last, contexts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of a cell's windows (rows, the lower doc first) with similar
    passages around both; ``place`` and ``last`` are where a row's windows lie
    in its surroundings. Equal passages of few words are joined as stars. Of
    the others those whose surroundings share most come first; pairs whose
    classes ``of`` are one, or were joined by a passage with all windows of
    both rows, are left out."""
    # copies of a class and its surroundings stand for each other: the first,
    # or the first of another document where that is the other window's
    names, first, second = {}, [], {}
    for k, name in enumerate(zip(*(x.tolist() for x in (of, settled, block, place, last)), (c.tobytes() for c in contexts))):
        n = names.setdefault(name, len(first))
        if n == len(first):
            first.append(k)
        elif n not in second and doc[k] != doc[first[n]]:
            second[n] = k
    use, other = [k for k in first if len(contexts[k]) >= LEAST], {k: second.get(n) for n, k in enumerate(first)}
    before = {k: _before(contexts[k]) for k in use}
    while True:                                       # without those that can be similar to none of the others
        if len(use) < 2 or (of[use] == of[use[0]]).all() or settled[use].all():
            return []
        around = _Surroundings([contexts[k] for k in use], [before[k] for k in use], place[use], last[use])
        use, held = np.array(use), settled[use]
        alone = np.zeros(len(use), bool)
        for rows in (np.flatnonzero(~held), np.flatnonzero(held)):
            alone[rows] = around.alone(rows)
            if alone[~held].all():
                return []
        if np.count_nonzero(alone) <= len(use) // 4:
            break
        use = use[~alone].tolist()
    fewest = np.array([_fewest(before[k], place[k], last[k]) for k in use.tolist()])
    parts = block[use]
    root, found = np.unique(of[use], return_inverse=True)[1], {}

    def ends(x, y):
        """The rows that stand for a pair, of two documents."""
        i, j = int(use[x]), int(use[y])
        if doc[i] == doc[j]:
            i, j = (i, other[j]) if other[j] is not None else (other[i], j)
        return None if i is None else (i, j) if doc[i] < doc[j] else (j, i)

    a, b, whole = _equal_stretches(around, [contexts[k] for k in use.tolist()])
    may = ~(held[a] & held[b]) & ((parts[a] != parts[b]) | (parts == parts[0]).all())
    for x, y, joins in zip(a[may].tolist(), b[may].tolist(), whole[may].tolist()):
        if root[x] != root[y] and (pair := ends(x, y)):
            found[pair] = True
            if joins:
                root[root == root[y]] = root[x]
    opens = np.flatnonzero(~held & ~alone)
    shared = _shared_counts(around.holds, opens)
    # s of p and q different shingles: s >= 0.8 * (p + q - s), and s is at most p and q
    least = [f * SIMILARITY - 1e-3 for f in (fewest[opens][:, None], fewest)]
    may = (shared >= np.maximum(*least)) & (shared * (1 + SIMILARITY) >= least[0] + least[1]) & (root[opens][:, None] != root)
    may &= (held | (opens[:, None] < np.arange(len(use)))) & ~alone     # each pair once
    if (parts != parts[0]).any():                 # each block's own pairs are another cell's
        may &= parts[opens][:, None] != parts
    a, b = np.nonzero(may)
    shared, a = shared[a, b], opens[a]
    some = around.possible(a, b, shared)
    a, b, shared = a[some], b[some], shared[some]
    order = np.argsort(-shared, kind="stable")
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if root[x] == root[y] or not (pair := ends(x, y)) or pair in found or not around.pair_possible(x, y):
            continue
        i, j = pair
        matches = verify(contexts[i], contexts[j])
        if any(p <= last[i] and q > place[i] and r <= last[j] and t > place[j] for p, q, r, t, _ in matches):
            found[pair] = True
            if any(p <= place[i] and q > last[i] and r <= place[j] and t > last[j] for p, q, r, t, _ in matches):
                root[root == root[y]] = root[x]
    return list(found)


_CELL = ["g_doc", "g_at", "i", "j"]


def _join_cells():
    """Pairs of each cell; rows come sorted by cell, and one may go on in the
    next batch."""
    def numbers(rows, names):
        return [rows.column(k).to_numpy() for k in names]

    def edges(rows):
        cell = np.stack(numbers(rows, _CELL))
        return np.append(np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(axis=0))), rows.num_rows)

    def pairs(rows):
        columns = numbers(rows, ["doc", "class", "settled", "block", "place", "last"])
        context = rows.column("context").combine_chunks()
        at, flat = context.offsets.to_numpy(), context.values.to_numpy()
        found, ends = [], edges(rows)
        for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if y - x > 1:
                made = _cell_pairs(*(c[x:y] for c in columns), [flat[at[k]:at[k + 1]] for k in range(x, y)])
                found += [(x + a, x + b) for a, b in made]
        sides = np.array(found, np.int64).reshape(-1, 2).T
        ends = [[c[side] for c in numbers(rows, ["doc", "lr", "at"])] for side in sides]
        return _links(None, *ends).drop_columns(["ask"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if rows.num_rows:
                last = int(edges(rows)[-2])
                if last:
                    yield pairs(rows.slice(0, last))
                held = rows.slice(last)
        if held is not None:
            yield pairs(held)
    return run


def _meetings(placed: DataFrame, content: DataFrame) -> DataFrame:
    """Links between windows of one key with similar passages around them.

    The keys of similar passages lie in them, so the surroundings (``MARGIN``)
    of two windows share as many shingles as a passage must, which is counted
    for all of a cell at once before passages are looked for. A cell has about
    ``CELL`` windows of a key against as many: they go by hash in blocks of such
    as are settled and such as are not, and each of the latter meets every
    block."""
    group = ["g_doc", "g_at"]
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    sizes = (placed.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(~F.col("settled")).alias("open"),
                                        F.min("class").alias("low"), F.max("class").alias("high"))
             .where("low != high AND open > 0").select(
                 *group, F.when(F.col("n") <= CELL, 1).otherwise(blocks(F.col("open"))).alias("opens"),
                 F.when(F.col("n") <= CELL, 0).otherwise(blocks(F.col("n") - F.col("open"))).alias("others")))
    sizes = materialise(sizes, "passage-cells")
    rows = (placed.join(sizes, group)
            .withColumn("block", F.expr("IF(settled AND others > 0, opens + pmod(hash(doc, at), others), pmod(hash(doc, at), opens))"))
            .withColumn("from", F.greatest(F.shiftright("lr", 32) - MARGIN, F.lit(0)))
            .withColumn("length", F.col("lr").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(MARGIN + 1) - F.col("from")))
    rows = (rows.join(content.withColumnRenamed("doc", "c_doc"), F.col("doc") == F.col("c_doc"))
            .withColumn("context", F.slice("s", (F.col("from") + 1).cast("int"), F.col("length").cast("int")))
            .withColumn("other", F.explode(F.expr("sequence(0, IF(settled AND others > 0, opens, opens + others) - 1)")))
            .select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "doc", "at", "lr", "class", "settled", "block", "context",
                    (F.shiftright("lr", 32) - F.col("from")).alias("place"),
                    (F.col("lr").bitwiseAND(F.lit(0xFFFFFFFF)) - F.col("from")).alias("last")))
    width = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (rows.repartition(width, *_CELL).sortWithinPartitions(*_CELL, "doc", "at")
            .mapInArrow(_join_cells(), T.StructType(LINKS.fields[1:])))


def _unsettled(windows: DataFrame, found: DataFrame, content: DataFrame, verified) -> DataFrame:
    """Passages of windows that have a key in common but no representative to
    which both are similar, but for those that verified passages join."""
    group = ["g_doc", "g_at"]
    several = (windows.groupBy(*group).agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("settled").alias("all"))
               .where("low < high AND NOT all").select(*group))
    several = materialise(several, "passage-groups")  # so that a hot key's windows can be split in the join
    windows = materialise(windows.join(several, group, "left_semi"), "passage-members")
    placed = materialise(_placed(windows, _classes(found)), "passage-placed")
    return verified(_by_pair(_meetings(placed, content)))


def near_duplicate_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per passage and representative, as the module describes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    pairs = materialise(_by_pair(window_links(rows)), "passage-pairs")
    involved = pairs.select(F.explode(F.array("a_doc", "b_doc")).alias("i_doc")).distinct()
    content = materialise(map_columns(
        rows.join(involved, F.col("doc") == F.col("i_doc"), "left_semi").dropDuplicates(["doc"]),
        ["text"], ["doc"], T.StructType([T.StructField("s", T.ArrayType(T.IntegerType()))]), _start_shingles),
        "passage-shingles")
    # whole copies are linked to their first, and only that meets others
    equal = content.select("doc", F.size("s").alias("n"), F.xxhash64("s").alias("h"), F.hash("s").alias("h2"))
    copies = (equal.join(equal.groupBy("n", "h", "h2").agg(F.min("doc").alias("first")), ["n", "h", "h2"])
              .where(f"doc != first AND n >= {LEAST}").select("doc", "first", F.col("n") + SHINGLE - 1))
    copies = materialise(copies.toDF("doc", "first", "words"), "passage-copies")
    verified = lambda pairs: materialise(_matches(_candidates(pairs), content), "passages")
    found = verified(pairs)
    windows = materialise(_stars(pairs, found).join(copies.select("doc"), ["doc"], "left_anti"), "passage-stars")
    found = found.unionByName(_unsettled(windows, found, content, verified))
    whole = copies.select(F.col("first").alias("a_doc"), F.col("doc").alias("b_doc"), F.lit(0).alias("match_start"),
                          F.col("words").alias("match_end"), F.lit(0).alias("start_word"), F.col("words").alias("end_word"),
                          F.lit(1.0).alias("similarity"))
    found = found.unionByName(whole.select(*[F.col(f.name).cast(f.dataType) for f in found.schema.fields]))
    return (found.select(F.col("b_doc").alias("doc_id"), "start_word", "end_word", F.col("a_doc").alias("match_id"),
                         "match_start", "match_end", "similarity").distinct())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_passages(table(spark, sf_dir, "documents", "doc_id", "text"))
