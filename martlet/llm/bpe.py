"""Byte-level BPE encoding and decoding.

Encoding: the merges are compiled into a finite-state transducer that is
determinised lazily. Its non-deterministic form may start a token at every
byte; the subset construction over the token trie makes one state of all tokens
under way, and each state knows the tokens that end in it. States and moves are
built when first met; there are no more than the trie has nodes.

Which of the tokens that end at a byte is the right one is decided by the token
before it: a token may follow another only if the two, encoded together, come
back as these two. A token sequence is the BPE encoding exactly if every
neighbouring pair is of this kind, so at most one token fits at each byte. The
transducer keeps these in registers for the bytes that tokens under way reach
back to; what all of them have in common before that is final and is emitted.
The lookahead is bounded by the longest token, and a piece of any length is
encoded in one pass with bounded memory.

Texts are cut into parts at single spaces and line ends (:mod:`.parts`), where
the pattern surely begins a piece, and each distinct part of a slice goes
through the transducer once. Pair decisions, pieces and parts are caches with a
size limit, which changes speed but no result.

Decoding looks token bytes up in blocks and streams each text's through an
incremental UTF-8 state machine; a character split between tokens or blocks is completed by the next,
and bytes that are not UTF-8 give U+FFFD.

Both directions are Arrow passes over rows that stay where they are. Edge
cases: NULL and empty texts have no tokens and decode to the empty text; rows
repeat as given; an id outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, table
from .parts import LINE, MAX_PART, Encoder, Recent

MAX_PAIRS = 400_000     # pair decisions kept
EMIT_EVERY = 4096       # bytes of a piece between emissions
MAX_PARTS = 500_000     # parts whose ids are kept
MAX_PIECES = 40_000     # encoded pieces kept
BLOCK = 1 << 16         # tokens decoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[int]:
    """Encoding by definition: merge the lowest-ranked pair, leftmost first,
    until no pair merges or ``stop`` parts are left. Used on single tokens and
    token pairs only, so its cost is theirs."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


_SHIFT = 20


class Transducer:
    """Lazily determinised transducer from a piece's bytes to token ids."""

    def __init__(self, ranks: dict[bytes, int], max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_pairs = ranks, max_pairs
        self.token = {i: t for t, i in ranks.items()}
        # trie: kids maps node << 8 | byte to a node, ends[node] is a token or -1
        self.kids: dict[int, int] = {}
        self.ends, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.kids.get(node << 8 | b)
                if nxt is None:
                    nxt = self.kids[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.ends[node] = rank
        if max(self.token, default=0) >= 1 << _SHIFT:
            raise ValueError("the vocabulary is too large")
        self.pairs: dict[int, bool] = {}         # (first + 1) << 20 | second
        self.halves: dict[int, tuple[int, int] | None] = {}
        # states: the trie nodes under way (deepest first), the tokens that end
        self.nodes: list[tuple[int, ...]] = [()]
        self.out: list[tuple[tuple[int, int], ...]] = [()]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        self.move: dict[int, int] = {}           # state << 8 | byte

    def _advance(self, state: int, byte: int) -> int:
        """The state after ``byte``, made when first met."""
        moved = [self.kids.get(node << 8 | byte) for node in (*self.nodes[state], 0)]
        nodes = tuple(n for n in moved if n is not None)
        if moved[-1] is None:
            raise ValueError("the ranks do not cover every byte")
        n = self.number.get(nodes)
        if n is None:
            n = self.number[nodes] = len(self.nodes)
            self.nodes.append(nodes)
            self.out.append(tuple((self.ends[x], self.depth[x]) for x in nodes if self.ends[x] >= 0))
        self.move[state << 8 | byte] = n
        return n

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; (token, token) for a
        byte; None if merging its bytes does not give it, or out of rank order."""
        known = self.halves.get(token, self)
        if known is not self:
            return known
        data = self.token[token]
        if len(data) == 1:
            out = (token, token)
        else:
            out = None
            parts = merge(data, self.ranks, stop=2)
            if len(parts) == 2 and max(parts) < token and None not in map(self._halves, parts):
                out = tuple(parts)
        self.halves[token] = out
        return out

    def follows(self, first: int, second: int) -> bool:
        """Whether ``second`` may come right after ``first`` (-1: at the start).

        Merges happen in rank order when every token ranks above its halves.
        Then, undoing the merges of both tokens from the latest back, the
        border survives if at no time the parts beside it could have merged
        before the merge that was just undone (on a tie the left one is first).
        """
        key = (first + 1) << _SHIFT | second
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) > self.max_pairs:
            self.pairs.clear()
        halves = self._halves
        if first < 0:
            known = halves(second) is not None or merge(self.token[second], self.ranks) == [second]
        elif halves(first) is None or halves(second) is None:
            known = merge(self.token[first] + self.token[second], self.ranks) == [first, second]
        else:
            known, token, rank_of = True, self.token, self.ranks.get
            a, b, before = first, second, 1 << 60
            while True:
                together = rank_of(token[a] + token[b])
                if together is not None and together < before:
                    known = False
                    break
                (_, a_right), (b_left, _) = halves(a), halves(b)
                if a_right == a and b_left == b:
                    break
                if b_left == b or (a_right != a and a > b):
                    before, a = a, a_right          # left merge undone: it won ties
                else:
                    before, b = b + 1, b_left       # right merge undone: it lost ties
        self.pairs[key] = known
        return known

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        emitted: list[int] = []
        # registers: last[i] is the token that ends at byte i (counted from the
        # last emission), None where none fits; -1 or a token at the start
        last: list[int | None] = [-1]
        known, moves, outs, state = self.pairs.get, self.move.get, self.out, 0
        for byte in piece:
            nxt = moves(state << 8 | byte)
            state = self._advance(state, byte) if nxt is None else nxt
            fits, i = None, len(last)
            for token, length in outs[state]:
                before = last[i - length] if length <= i else None
                if before is not None:
                    ok = known((before + 1) << _SHIFT | token)
                    if self.follows(before, token) if ok is None else ok:
                        fits = token
                        break
            last.append(fits)
            if i >= EMIT_EVERY:
                last = self._emit(last, state, emitted)
        self._chain(last, len(last) - 1, emitted)
        return emitted

    def _chain(self, last: list, end: int, emitted: list[int]) -> None:
        """Append the tokens from the first register to ``end``."""
        found, i = [], end
        while i > 0:
            token = last[i]
            if token is None:
                raise ValueError("no encoding")
            found.append(token)
            i -= len(self.token[token])
        emitted.extend(reversed(found))

    def _emit(self, last: list, state: int, emitted: list[int]) -> list:
        """Emit what all tokens under way have in common; the other registers."""
        end = len(last) - 1
        live = {end - self.depth[n] for n in self.nodes[state]} | {end}
        live = {i for i in live if i >= 0 and last[i] is not None}
        while len(live) > 1:
            i = max(live)
            live.remove(i)
            live.add(i - len(self.token[last[i]]) if i > 0 else 0)
        common = live.pop()
        if common <= 0:
            return last
        self._chain(last, common, emitted)
        return last[common:]


class Codec:
    """Whole texts to ids and back, many at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(MAX_PIECES)
        self.encoder = Encoder(lambda parts: list(map(self._part, parts)), MAX_PARTS)
        # all tokens' bytes in a row, and where each begins
        top = max(ranks.values(), default=-1)
        by_id: list[bytes | None] = [None] * (top + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.known = np.array([t is not None for t in by_id], bool)
        self.size = np.array([len(t or b"") for t in by_id], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(t or b"" for t in by_id), np.uint8)

    @property
    def spaced(self) -> Recent:
        """The parts whose ids are kept."""
        return self.encoder.known

    @spaced.setter
    def spaced(self, value: Recent) -> None:
        self.encoder.known = value

    def _ids(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode())).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a part of a text. A blank and ASCII letters need no pattern
        to be cut."""
        word = part[1:]
        if word.isascii() and word.isalpha():
            if part[0] == " ":
                return self._ids(part)
            if part[0] == LINE:
                return self._ids(LINE) + self._ids(word)
        found = []
        for piece in self.find(part):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self._ids(piece)
                if len(piece) <= MAX_PART:
                    self.pieces.put(piece, ids)
            found.append(ids)
        return b"".join(found)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        return self.encoder.encode(texts)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as int32 bytes."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype(np.int32).tobytes()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids. ``BLOCK`` ids at a time become bytes, by
        one lookup; an incremental UTF-8 machine reads each text's bytes."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        edges = np.concatenate(([0], np.cumsum(counts))).tolist()
        out: list[str] = []
        held: list[str] = []            # of a text that goes on in the next block
        for at in range(0, max(1, len(ids)), BLOCK):
            some = ids[at:at + BLOCK]
            size = self.size[some]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            data = memoryview(self.bytes[np.repeat(self.start[some] - (ends - size), size) + np.arange(total)])
            places = np.concatenate(([0], ends))
            begin = 0
            while len(out) < len(counts) and edges[len(out) + 1] <= at + len(some):
                end = int(places[edges[len(out) + 1] - at])
                text = machine.decode(data[begin:end], True)
                machine.reset()
                out.append("".join(held) + text if held else text)
                held, begin = [], end
            if begin < total:
                held.append(machine.decode(data[begin:]))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    return Codec(read_ranks(path), pattern)


def _default(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers
    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.StringType())


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32, copy=False)))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None,
           path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns (default all) and ``ids`` (array of int)."""
    path, pattern = _default(path, pattern)

    def start():
        c = codec(path, pattern)
        return lambda texts: [_id_lists(*c.encode_all(texts))]
    return map_columns(docs, [text], list(keep or docs.columns), T.StructType([IDS]), start)


def decode(coded: DataFrame, ids: str = "ids", keep: tuple[str, ...] | None = None,
           path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns (default all) and ``decoded`` (text). NULL: empty."""
    path, pattern = _default(path, pattern)

    def start():
        c = codec(path, pattern)

        def run(lists):
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            return [c.decode_all(lists.flatten().to_numpy(zero_copy_only=False), counts)]
        return run
    return map_columns(coded, [ids], list(keep or coded.columns), T.StructType([DECODED]), start)


def round_trip(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None,
               path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` and the text decoded from them: both
    directions in one pass, so that a task has one Python worker and one set of
    tables."""
    path, pattern = _default(path, pattern)

    def start():
        c = codec(path, pattern)

        def run(texts):
            ids, counts = c.encode_all(texts)
            return [_id_lists(ids, counts), c.decode_all(ids, counts)]
        return run
    return map_columns(docs, [text], list(keep or docs.columns), T.StructType([IDS, DECODED]), start)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row."""
    back = round_trip(docs.select("doc_id", "text"), keep=("doc_id",))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: encode and decode every remaining document."""
    return digests(docs)
