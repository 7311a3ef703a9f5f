"""Token counts without materialising ids.

Method: pieces are counted once per distinct pre-token by the tokenizer
library; documents are reduced to pre-token frequencies, and the two are
joined and summed.

A pre-token here is a maximal run without ASCII white space. The tokenizer
drops white space, never merges across it, and neither its normaliser nor its
special strings reach over it, so the pieces of a text are the sum of the
pieces of its pre-tokens.

* The vocabulary (pre-token, occurrences, pieces) is one grouped count with
  map-side partial sums, written once. The library sees every entry once.
* Pre-tokens are split by a frequency floor chosen from a histogram of the
  counts so that at most ``HEAD`` entries lie above it. That head, bounded by
  ``HEAD`` entries and ``HEAD_BYTES`` of text, goes to every task, which adds
  its pieces up by lookup; it covers most of any corpus.
* The rest, per document and pre-token, is shuffled by pre-token to the
  vocabulary and then by row to the sums. A frequent pre-token is in the head
  by construction, so no tail key is hot.
* The row's own sum travels under a key of its own (a key with a blank in it,
  which no pre-token has), so that one join and one sum serve both parts and
  texts are read once.

Edge cases: NULL and empty texts have no tokens and no bytes; rows are counted
one by one, also repeated ones; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, table

BLANKS = " \t\n\x0b\x0c\r"
_TO_SPACE = {ord(c): " " for c in BLANKS}
HEAD = 100_000
HEAD_BYTES = 4 << 20
LIMIT = 2048
_loaded: dict[str, object] = {}


def pre_tokens(text: str | None) -> list[str]:
    """Runs without ASCII white space, in order."""
    if not text:
        return []
    parts = text.translate(_TO_SPACE).split(" ") if any(c in text for c in BLANKS[1:]) else text.split(" ")
    return [p for p in parts if p]


def tokenizer(path: str):
    """One tokenizer per Python worker, on the task's own core."""
    found = _loaded.get(path)
    if found is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return found


def _pieces(path: str):
    def run(words):
        made, batch, out = tokenizer(path), words.to_pylist(), []
        for i in range(0, len(batch), 1000):
            out += [len(e.ids) for e in made.encode_batch(batch[i:i + 1000], add_special_tokens=False)]
        return [out]
    return run


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``word, occurrences, pieces`` for every distinct pre-token of ``docs``."""
    stripped = F.translate(F.col(text), BLANKS[1:], " " * len(BLANKS[1:]))
    counts = (docs.select(F.explode(F.split(stripped, " ")).alias("word")).where("word != ''")
              .groupBy("word").agg(F.count("*").alias("occurrences")))
    return map_columns(counts, ["word"], ["word", "occurrences"],
                       T.StructType([T.StructField("pieces", T.LongType())]), lambda: _pieces(path))


def head(words: DataFrame, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> tuple[int, dict[str, int]]:
    """A frequency floor and the vocabulary from there up. The histogram has
    a bin per eighth of an octave of the counts, whatever the corpus."""
    level = F.floor(F.log2("occurrences") * 8).cast("int")
    bins = (words.groupBy(level.alias("level")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("bytes"),
        F.min("occurrences").alias("floor")).orderBy(F.desc("level")).collect())
    n = size = 0
    floor = None
    for b in bins:
        n, size = n + b.n, size + b.bytes
        if n > most or size > most_bytes:
            break
        floor = b.floor
    if floor is None:
        return 1 << 62, {}
    return floor, {r.word: r.pieces for r in words.where(F.col("occurrences") >= floor)
                   .select("word", "pieces").collect()}


FREQUENCIES = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("head_tokens", T.LongType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType()))])


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = materialise(vocabulary(rows, path), "pre-tokens")
    floor, known = head(words)
    pieces_of = rows.sparkSession.sparkContext.broadcast(known)

    def start():
        pieces = pieces_of.value

        def run(texts):
            sizes, sums, rest, times = [], [], [], []
            for t in texts.to_pylist():
                n, own, own_times = 0, [], []
                for word, k in Counter(pre_tokens(t)).items():
                    p = pieces.get(word)
                    if p is None:
                        own.append(word)
                        own_times.append(k)
                    else:
                        n += p * k
                sizes.append(len(t.encode()) if t else 0)
                sums.append(n)
                rest.append(own)
                times.append(own_times)
            return [sizes, sums, rest, times]
        return run

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    parts = map_columns(numbered, ["text"], ["row", "doc_id"], FREQUENCIES, start)
    own = F.struct(F.concat(F.lit(" "), F.col("row").cast("string")).alias("word"), F.lit(1).alias("times"),
                   F.col("doc_id"), F.col("n_bytes"), F.col("head_tokens"))
    each = F.transform(F.arrays_zip("words", "times"), lambda x: F.struct(
        x["words"].alias("word"), x["times"].alias("times"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("head_tokens")))
    keyed = parts.select("row", F.explode(F.concat(F.array(own), each)).alias("x")).select("row", "x.*")
    tail = words.where(F.col("occurrences") < floor).select(F.col("word").alias("v_word"), "pieces")
    joined = keyed.join(tail, F.col("word") == F.col("v_word"), "left")
    return (joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("head_tokens", F.col("times") * F.col("pieces"))).cast("long").alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
