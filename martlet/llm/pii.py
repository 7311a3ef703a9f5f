"""Personal data by weak supervision.

Method: candidate spans are labelled by several weak voters (format, checksum,
gazetteer, context, border). Expectation-maximisation over the counts of vote
patterns estimates how reliable each voter is for each kind; the posteriors
train a final logistic span classifier over votes and shape, which decides on
every candidate outside the base patterns. Base matches are always spans.

* One Arrow pass counts vote patterns. Pattern counts are summed in Spark;
  their number is bounded by kinds x 3^voters x shapes, so the few rows that
  reach the driver do not grow with the corpus. All documents are counted.
* A second pass finds the spans with the trained weights (a few numbers).
  Texts are never shuffled.
* All scans are linear in the text, also over long runs of digits or letters.

Edge cases: NULL and empty texts have no spans; a corpus without candidates
trains nothing and returns no added spans; rows repeat as given. Offsets are
code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, table

KINDS = ("email", "ip", "card", "phone")

_DIGIT = re.compile("[0-9]")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot begin inside a run of digits unless it also begins at its start
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# further candidates
_EMAIL_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}"
                       r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{1,63}){1,8}")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_NATIONAL = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_PREFIX_00 = re.compile(r"(?<![0-9])00[1-9][ ().0-9-]{7,24}[0-9](?![0-9])")

#: Gazetteers: common top-level domains, card issuer prefixes, calling codes.
TLDS = frozenset("com net org edu gov mil int info biz io eu uk de fr es it nl be ch at se no dk fi pl pt ie ru "
                 "cn jp kr in br mx ca us au nz za".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "60", "65", "35", "30", "36", "38")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
           "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
           "86", "90", "91", "92", "351", "353", "358", "420", "971", "972")
#: Context cues in the 40 characters before a candidate.
CUES = {"email": ("mail", "contact", "write to", "correo", "courriel"),
        "ip": ("ip", "host", "server", "address", "login from"),
        "card": ("card", "visa", "mastercard", "amex", "tarjeta", "carte", "karte"),
        "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp", "telefon")}
AGAINST = ("isbn", "order", "serial", "version", "invoice", "sku", "token", "commit", "page", "section")
_CUES = {k: re.compile(r"\b(?:" + "|".join(v) + r")") for k, v in CUES.items()}
_AGAINST = re.compile(r"\b(?:" + "|".join(AGAINST) + r")")
CONTEXT = 40
VOTERS = ("format", "checksum", "gazetteer", "context", "border")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    """Leftmost, non-overlapping: the local part is the run before an @."""
    at, free = text.find("@"), 0
    while at >= 0:
        run = text[free:at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Base matches of a whole text, by start, then kind as listed."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_at_most_255, m.group().split("."))):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return in_order(found)


def in_order(spans):
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Taken:
    """Disjoint intervals, joined from spans, with a fast overlap test."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b


def _further(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns."""
    found = []
    if "at)" in text or "at]" in text:
        found += [("email", m.start(), m.end()) for m in _EMAIL_AT.finditer(text)]
    if _DIGIT.search(text):
        if text.count(":") >= 7:
            found += [("ip", m.start(), m.end()) for m in _IPV6.finditer(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= sum("0" <= c <= "9" for c in m.group()) <= 19:
                found.append(("card", m.start(), m.end()))
        for p in (_NATIONAL, _PREFIX_00):
            found += [("phone", m.start(), m.end()) for m in p.finditer(text)]
    return found


def _votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """+1 personal, -1 not, 0 no opinion, per voter."""
    span = text[a:b]
    digits = "".join(c for c in span if "0" <= c <= "9")
    checksum = gazetteer = 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    elif kind == "phone":
        checksum = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = 1 if digits.lstrip("0").startswith(CALLING) else 0
    elif kind == "email":
        gazetteer = 1 if re.split(r"[^a-z]+", span.lower())[-1] in TLDS else -1
    else:
        first = span.split(".")[0]
        gazetteer = -1 if first in ("0", "127") else 0
    before = text[max(0, a - CONTEXT):a].lower()
    context = -1 if _AGAINST.search(before) else 1 if _CUES[kind].search(before) else 0
    glued = (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")) or (
        b < len(text) and (text[b].isalnum() or text[b] == "_"))
    return (1 if base else 0, checksum, gazetteer, context, -1 if glued else 0)


def candidates(text: str | None) -> list[tuple[str, int, int, bool, tuple[int, ...], int]]:
    """(kind, start, end, base, votes, shape) of every candidate span."""
    if not text:
        return []
    base = base_spans(text)
    taken = Taken(base)
    spans = [(s, True) for s in base] + [(s, False) for s in dict.fromkeys(_further(text)) if not taken.meets(*s[1:])]
    return [(k, a, b, is_base, _votes(text, k, a, b, is_base), min(7, (b - a) // 4))
            for (k, a, b), is_base in spans]


PATTERN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("votes", T.ArrayType(T.IntegerType())),
                        T.StructField("shape", T.IntegerType()), T.StructField("n", T.LongType())])


def vote_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts of (kind, votes, shape) over all candidates of all documents."""
    def start():
        def run(texts):
            counts = [Counter((k, v, s) for k, _, _, _, v, s in candidates(t)) for t in texts.to_pylist()]
            return [[[{"kind": k, "votes": list(v), "shape": s, "n": n} for (k, v, s), n in c.items()]
                     for c in counts]]
        return run
    found = map_columns(docs.select(text), [text], [], T.StructType([
        T.StructField("patterns", T.ArrayType(PATTERN))]), start)
    return (found.select(F.explode("patterns").alias("p")).groupBy("p.kind", "p.votes", "p.shape")
            .agg(F.sum("p.n").alias("n")))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple, float]:
    """Posterior of (kind, votes) by EM with one reliability table per kind
    and voter. ``patterns``: (kind, votes, count). Starts from the majority."""
    out = {}
    for kind in KINDS:
        rows = Counter()
        for k, v, n in patterns:
            if k == kind:
                rows[v] += n
        if not rows:
            continue
        votes = np.array(list(rows), int) + 1                       # 0, 1, 2
        n = np.array(list(rows.values()), float)
        p = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(1)))
        for _ in range(rounds):
            weight = np.stack([n * (1 - p), n * p])                 # class x pattern
            prior = (weight.sum(1) + 1) / (n.sum() + 2)
            log = np.repeat(np.log(prior)[:, None], len(n), 1)
            for j in range(votes.shape[1]):
                # smoothing towards a voter that is right more often than not
                table = np.array([[1.0, 1.0, 0.25], [0.25, 1.0, 1.0]])
                for value in range(3):
                    table[:, value] += weight[:, votes[:, j] == value].sum(1)
                table /= table.sum(1, keepdims=True)
                log += np.log(table[:, votes[:, j]])
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        out.update({(kind, tuple(int(x) - 1 for x in v)): float(q) for v, q in zip(votes, p)})
    return out


def _features(kind: str, votes: tuple[int, ...], shape: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) * (2 * len(VOTERS) + 1) + 8)
    x[0] = 1
    at = 1 + KINDS.index(kind) * (2 * len(VOTERS) + 1)
    x[at] = 1
    for j, v in enumerate(votes):
        if v:
            x[at + 1 + 2 * j + (v > 0)] = 1
    x[-8 + shape] = 1
    return x


def train(counted: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 30) -> np.ndarray | None:
    """Weights of the span classifier: ridge logistic regression (Newton) on
    the posteriors of all candidates, weighted by their counts."""
    if not counted:
        return None
    posterior = estimate([(k, v, n) for k, v, _, n in counted])
    x = np.stack([_features(k, v, s) for k, v, s, _ in counted])
    y = np.array([posterior[k, v] for k, v, _, _ in counted])
    n = np.array([float(c) for *_, c in counted])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + 0.1 * w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = np.clip(w - np.linalg.solve(hessian, gradient), -30, 30)
    return w


def fit(docs: DataFrame, text: str = "text") -> np.ndarray | None:
    """Train over all documents; only the pattern counts reach the driver."""
    rows = vote_patterns(docs, text).orderBy("kind", "votes", "shape").collect()
    return train([(r.kind, tuple(r.votes), r["shape"], r.n) for r in rows])


def find(text: str | None, weights: np.ndarray | None) -> tuple[list, list]:
    """Base spans, and all spans: base ones and the accepted further
    candidates (none overlaps a base span; of two that overlap, the earlier)."""
    got = candidates(text)
    base = [c[:3] for c in got if c[3]]
    added, end = [], 0
    if weights is not None:
        for k, a, b, is_base, votes, shape in sorted(got, key=lambda c: c[1]):
            if not is_base and a >= end and _features(k, votes, shape) @ weights >= 0:
                added.append((k, a, b))
                end = b
    return in_order(base), in_order(base + added)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
SPANS = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN)),
                      T.StructField("masked", T.StringType())])


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (overlapping ones joined) as ``[KIND]``."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, weights: np.ndarray | None, text: str = "text",
           keep: tuple[str, ...] | None = None, masked: bool = False) -> DataFrame:
    """``keep`` columns (default all), ``base`` and ``spans`` (kind, start,
    end), and with ``masked`` the text with all spans masked (else NULL)."""
    def start():
        def run(texts):
            texts = texts.to_pylist()
            found = [find(t, weights) for t in texts]
            as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return [[as_rows(b) for b, _ in found], [as_rows(s) for _, s in found],
                    [mask(t, s) if masked else None for t, (_, s) in zip(texts, found)]]
        return run
    return map_columns(docs, [text], list(keep or docs.columns), SPANS, start)


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = detect(docs, fit(docs), keep=("doc_id",))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every span is masked in ``text``; ``n_chars`` follows."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = detect(whole, fit(docs), keep=("row",), masked=True)
    changed = {"text": F.col("masked"), "n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"row.{c}") for c in docs.columns])
