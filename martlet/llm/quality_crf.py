"""Quality classifier: a linear-chain conditional random field over lines.

Method: every line of a document is good or bad. A line's evidence is a set of
text features of itself and of the lines before and after it; neighbouring
labels are tied by transition weights. Forward-backward gives each line's
marginal probability of being good, and their mean weighted by line length is
the document's score.

* Training uses a bounded sample, ``MAX_TRAIN`` labelled documents in hash
  order of their id, each of at most ``MAX_TRAIN_LINES`` lines; only their line
  features (not texts) reach the driver. A labelled document gives its label to
  all of its lines. Optimisation is full-batch and starts from zero, so equal
  samples give equal weights.
* Scoring is one Arrow pass over all documents and whole texts with the
  trained weights (under a hundred numbers). Texts are never shuffled.
* Forward-backward runs over all documents of a batch at once, line by line.

Edge cases: lines of white space only are left out; NULL, empty and blank
texts are scored as one line without any content; repeated rows score alike;
without any usable label every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, table

MAX_TRAIN = 4000
MAX_TRAIN_LINES = 2000
ROUNDS = 250
RIDGE = 1e-3
THRESHOLD = 0.3
BATCH_BYTES = 8 << 20

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:?'\"-"
_BEYOND = bytes(range(0x80, 0x100))
FEATURES = ("length", "upper", "lower", "digits", "symbols", "stops", "exclaim", "beyond", "word length",
            "short words", "distinct", "repeats", "duplicate", "ends", "starts", "words", "exists")


def line_features(text: str | None) -> tuple[list[list[float]], list[int]]:
    """Features and lengths of the lines of a text that are not blank."""
    rows, sizes, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        raw = line.encode()
        n, k = len(raw), len(words)
        share = lambda chars: (n - len(raw.translate(None, chars))) / n  # noqa: B023, E731
        letters = sum(map(len, words))
        rows.append([
            np.log1p(n) / 8, share(_UPPER), share(_LOWER), share(_DIGITS), share(_SYMBOLS), share(_STOPS),
            raw.count(b"!") / n, share(_BEYOND), min(letters / k, 30) / 10,
            sum(map((4).__gt__, map(len, words))) / k, len(set(words)) / k,
            sum(map(eq, words, words[1:])) / k, float(line in seen), float(words[-1][-1] in ".?!"),
            float(words[0][0].isupper()), np.log1p(k) / 6, 1.0])
        seen.add(line)
        sizes.append(len(line))
    return (rows, sizes) if rows else ([[0.0] * len(FEATURES)], [1])


@dataclass(frozen=True)
class Weights:
    mean: np.ndarray        # per feature
    scale: np.ndarray
    lines: np.ndarray       # three blocks: own line, line before, line after
    bias: float
    steps: np.ndarray       # 2 x 2, from label to label


def _blocks(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features (zero outside the document)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts], after[starts + sizes - 1] = 0, 0
    return np.hstack([x, before, after])


def forward_backward(energy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: np.ndarray,
                     pairs: bool = False):
    """Marginals (lines x 2), and with ``pairs`` the expected label steps
    summed over all documents. ``energy`` is good's log-odds per line."""
    good = 1 / (1 + np.exp(-np.clip(energy, -40, 40)))
    emit = np.stack([1 - good, good], 1) + 1e-300
    move = np.exp(steps - steps.max())
    order = np.argsort(-sizes, kind="stable")
    first, size = starts[order], sizes[order]
    longest = int(size[0])
    # documents that have a line t, for every t
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    a = None
    for t in range(longest):
        at = first[:active[t]] + t
        a = emit[at] if t == 0 else (a[:active[t]] @ move) * emit[at]
        a = a / a.sum(1, keepdims=True)
        ahead[at] = a
    expected = np.zeros((2, 2))
    b = np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        now = np.ones((k, 2))
        if t + 1 < longest:
            later = first[:active[t + 1]] + t + 1
            weighted = emit[later] * b
            now[:len(b)] = weighted @ move.T
            now /= now.sum(1, keepdims=True)
            if pairs:
                both = ahead[later - 1][:, :, None] * move[None] * weighted[:, None, :]
                expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        back[first[:k] + t] = b = now
    out = ahead * back
    return out / out.sum(1, keepdims=True), expected


def train(documents: list[tuple[list[list[float]], int]], rounds: int = ROUNDS) -> Weights | None:
    """Fit to (line features, label) by conditional likelihood (Adam, ridge)."""
    if not documents:
        return None
    sizes = np.array([len(r) for r, _ in documents])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    x = np.concatenate([np.asarray(r, float) for r, _ in documents])
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = _blocks((x - mean) / scale, starts, sizes)
    z = np.hstack([z, np.ones((len(z), 1))])
    label = np.repeat([y for _, y in documents], sizes)
    observed = np.zeros((2, 2))
    for (rows, y) in documents:
        observed[y, y] += len(rows) - 1
    w, steps = np.zeros(z.shape[1]), np.zeros((2, 2))
    state = [np.zeros(z.shape[1] + 4) for _ in range(2)]
    n = len(documents)
    for k in range(1, rounds + 1):
        marginal, expected = forward_backward(z @ w, starts, sizes, steps, pairs=True)
        gradient = np.concatenate([z.T @ (marginal[:, 1] - label) / n + RIDGE * w,
                                   ((expected - observed) / n + RIDGE * steps).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.999 * state[1] + 0.001 * gradient ** 2
        move = 0.05 * (state[0] / (1 - 0.9 ** k)) / (np.sqrt(state[1] / (1 - 0.999 ** k)) + 1e-8)
        w -= move[:-4]
        steps -= move[-4:].reshape(2, 2)
    return Weights(mean, scale, w[:-1], float(w[-1]), steps)


def score(texts: list[str | None], weights: Weights | None) -> list[float]:
    """Length-weighted mean marginal of good per text."""
    if weights is None:
        return [0.5] * len(texts)
    out: list[float] = []
    rows, lengths, sizes, held = [], [], [], 0

    def flush():
        count = np.array(sizes)
        starts = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64)
        z = _blocks((np.array(rows) - weights.mean) / weights.scale, starts, count)
        marginal, _ = forward_backward(z @ weights.lines + weights.bias, starts, count, weights.steps)
        length = np.array(lengths, float)
        total = np.add.reduceat(length * marginal[:, 1], starts) / np.add.reduceat(length, starts)
        out.extend(np.clip(total, 0, 1).tolist())

    for text in texts:
        r, s = line_features(text)
        rows += r
        lengths += s
        sizes.append(len(r))
        held += len(text or "")
        if held >= BATCH_BYTES:
            flush()
            rows, lengths, sizes, held = [], [], [], 0
    if sizes:
        flush()
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        most: int = MAX_TRAIN, most_lines: int = MAX_TRAIN_LINES) -> Weights | None:
    """Train on a bounded sample of the labelled rows that are not held out."""
    chosen = (labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("y").isin(0, 1) & ~held_out("l_id")).distinct()
              .orderBy(F.xxhash64("l_id"), "l_id", "y").limit(most))
    rows = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text"))
    # at most ``most`` ids: a proven bound for the broadcast
    sample = rows.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("l_id", "y", "text")

    def start():
        def run(texts):
            made = [line_features(t)[0] for t in texts.to_pylist()]
            return [[r if len(r) <= most_lines else None for r in made]]
        return run
    shape = T.StructType([T.StructField("lines", T.ArrayType(T.ArrayType(T.DoubleType())))])
    got = map_columns(sample, ["text"], ["l_id", "y"], shape, start).where("lines IS NOT NULL").collect()
    got.sort(key=lambda r: (r.l_id, r.y, r.lines))
    return train([(r.lines, r.y) for r in got])


def classify(docs: DataFrame, weights: Weights | None, text: str = "text",
             keep: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` columns (default all) and ``score``."""
    return map_columns(docs, [text], list(keep or docs.columns),
                       T.StructType([T.StructField("score", T.DoubleType())]),
                       lambda: lambda texts: [score(texts.to_pylist(), weights)])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    weights = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = classify(docs, weights, keep=("doc_id",))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
