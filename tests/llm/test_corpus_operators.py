"""Operators that compare documents with each other, and the pipeline."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from llm_cases import SF_SMALL, empty, small, texts  # noqa: F401
from martlet.llm import bpe, decontaminate, passages, pii, quality_rules, registry, simhash


# ---- SimHash

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), seed=42) for i in range(len(words) - k + 1)] if k else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable over links of at most four bits, by union-find."""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    fps = np.array([f for _, f in prints], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            up[find(int(j))] = find(i)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(prints))]


@pytest.mark.parametrize("where", ["small", "supplied"])
def test_simhash_query(spark, small, where):
    root = small if where == "small" else SF_SMALL
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    want = collections.Counter((i, f"{f:016x}", c) for (i, f), c in zip(prints, plain_components(prints)))
    got = collections.Counter(tuple(r) for r in registry.queries()["op2_simhash_near_dedup"](spark, root).collect())
    assert got == want


def test_links_are_complete(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(8):                       # neighbours at up to six bits, in any segment
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i]
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {tuple(r) for r in simhash.links(df).distinct().collect()} == want
    with pytest.raises(ValueError):
        simhash.links(df, max_bits=6)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(205, 201), (205, 203)]
    rows = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 201: 201, 203: 201, 205: 201}
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)


# ---- passages

def test_compact_windows_against_definition():
    rng = np.random.default_rng(2)
    sequences = [rng.integers(0, 2 ** 63, size=n).astype(np.uint64) for n in (0, 10, 45, 46, 47, 300)]
    sequences.append(np.repeat(sequences[-1][:5], 30))               # many ties
    seq, fn, l, c, r, _, _ = passages.compact_windows(sequences)  # noqa: E741
    for s, values in enumerate(sequences):
        for i in range(passages.HASHES):
            h = passages._mixed(values + passages._SEEDS[i])
            bits = 10                            # ties of the kept bits go to the left
            order = [((int(x) >> bits), p) for p, x in enumerate(h)]
            want = []
            for at in range(len(h)):
                a = b = at
                while a and order[a - 1] > order[at]:
                    a -= 1
                while b + 1 < len(h) and order[b + 1] > order[at]:
                    b += 1
                if b - a + 1 >= passages.LEAST:
                    want.append((a, at, b))
            got = (seq == s) & (fn == i)
            assert sorted(zip(l[got].tolist(), c[got].tolist(), r[got].tolist())) == sorted(want)


def test_passage_query(spark, small, texts):
    rows = registry.queries()["op3_substring_dedup"](spark, small).collect()
    words = {i: (t or "").lower().split() for i, t in texts}
    linked = collections.defaultdict(set)
    for r in rows:
        a, b = words[r.doc_id][r.start_word:r.end_word], words[r.match_id][r.match_start:r.match_end]
        left, right = ({tuple(x[k:k + 5]) for k in range(len(x) - 4)} for x in (a, b))
        assert min(len(a), len(b)) >= 50 and r.similarity == pytest.approx(len(left & right) / len(left | right))
        assert r.similarity >= 0.8 and r.doc_id != r.match_id
        linked[r.doc_id].add(r.match_id)
        linked[r.match_id].add(r.doc_id)
    group = lambda i: {i} | {k for j in linked[i] for k in linked[j]} | linked[i]
    assert group(75) == {75, 76, 77, 78}          # 78 has one word changed
    assert group(3) == {3, 71, 72} and group(4) == {4, 73} and group(5) == {5, 74}
    assert not any(linked[i] for i in range(11, 71)) and not linked[87]


def test_every_shared_window_is_linked(spark):
    docs = [(r.doc_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    holders = collections.defaultdict(set)
    for i, w in docs:
        for k in range(len(w) - 49):
            holders[tuple(w[k:k + 50])].add(i)
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for r in registry.queries()["op3_substring_dedup"](spark, SF_SMALL).collect():
        up[find(r.doc_id)] = find(r.match_id)
    shared = [s for s in holders.values() if len(s) > 1]
    assert shared and all(len({find(i) for i in s}) == 1 for s in shared)


def joined(rows):
    """Root of each document over the links of a result."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for r in rows:
        up[find(r.doc_id)] = find(r.match_id)
    return find


def passage_documents(rng, n_pairs):
    """Passages in unrelated text, with one to four changed words in every
    second copy, some in many documents, some twice in one; whole copies."""
    words = lambda n: [f"w{rng.getrandbits(32):x}" for _ in range(n)]
    rows, pairs = [], []
    for k in range(n_pairs):
        p = words(rng.randint(60, 200))
        q = list(p)
        for at in rng.sample(range(len(q)), rng.randint(1, 4)):
            q[at] = "changed"
        grams = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in (p, q)]
        rows += [words(rng.randint(10, 90)) + x + words(rng.randint(10, 90)) for x in (p, q)]
        if len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1]):
            pairs.append((2 * k, 2 * k + 1))
    hot = words(70)
    rows += [words(rng.randint(5, 60)) + hot + words(20) + (hot if i % 9 == 0 else []) for i in range(60)]
    rows += [rows[-1], rows[3], rows[3]]
    return [(i, " ".join(r)) for i, r in enumerate(rows)], pairs


def test_rows_do_not_depend_on_partitioning(spark):
    rows, _ = passage_documents(random.Random(21), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, found = spark.conf.get(conf), []
    try:
        for parts, batch in ((3, 10000), (16, 10000), (5, 4), (1, 33)):
            spark.conf.set(conf, str(batch))
            got = passages.near_duplicate_passages(df.repartition(parts, "text")).collect()
            found.append(collections.Counter(map(tuple, got)))
    finally:
        spark.conf.set(conf, before)
    assert found[0] and all(f == found[0] for f in found[1:])


def test_near_passages_are_found(spark):
    """Recall of passages that are similar to 0.8 and more but not equal."""
    rows, pairs = passage_documents(random.Random(22), 150)
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    find = joined(got)
    caught = sum(find(a) == find(b) for a, b in pairs)
    assert len(pairs) > 80 and caught >= 0.9 * len(pairs), (caught, len(pairs))
    assert all(r.similarity >= 0.8 for r in got)


def test_blocks_keep_their_columns():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 1 << 60, 50).astype(t) for t in passages._KEYED]
    back = passages._unpack(passages._pack(columns, passages._KEYED), 50, passages._KEYED)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(columns, back))


def test_hot_passages_meet_over_many_batches(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.getrandbits(32):x}" for _ in range(n)]
    hot = [words(51) for _ in range(6)]
    rows = []
    for k, p in enumerate(hot):
        for _ in range(40):
            rows.append(words(rng.randint(20, 90)) + p + words(rng.randint(20, 90)))
        grams = [p[i:i + 5] for i in range(47)]
        for g in grams * 3:                      # others hold only one of its shingles
            rows.append(words(60) + g + words(60))
        rows += [words(60) + p[:26] + words(60) for _ in range(20)] + [words(60) + p[25:] + words(60) for _ in range(20)]
    rng.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
        got = passages.near_duplicate_passages(df).collect()
    finally:
        spark.conf.set(conf, before)
    find = joined(got)
    holders = [{i for i, t in rows if " ".join(p) in t} for p in hot]
    assert [len(h) for h in holders] == [40] * 6
    assert [len({find(i) for i in h}) for h in holders] == [1] * 6
    assert {i for r in got for i in (r.doc_id, r.match_id)} == set.union(*holders)


@pytest.mark.parametrize("edited", [False, True])
def test_passages_meet_where_representatives_hold_a_part(spark, edited):
    """The first documents hold 30 words from each place of a passage of 60,
    too few to be similar; two later ones hold it whole."""
    rng = random.Random(14)
    words = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    passage = words(60)
    other = passage[:40] + ["changed"] + passage[41:] if edited else passage
    rows = [words(40) + passage[k:k + 30] + words(40) for k in range(31)] + [words(50) + p + words(50) for p in (passage, other)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.match_id) for r in got] == [(32, 31)]
    assert got[0].similarity >= 0.8 and got[0].end_word - got[0].start_word >= 50


def test_common_phrases_are_not_compared_pair_by_pair(spark, monkeypatch):
    """150 documents hold 30 words in other text, too few for a passage, and
    three of them a passage that goes on. What is verified grows with the
    documents, not with their pairs."""
    rng = random.Random(15)
    words = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    passage = words(70)
    rows = [words(60) + passage[:70 if i in (40, 90, 149) else 30] + words(60) for i in range(150)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    by_pair, sizes = passages._by_pair, []

    def counted(links):
        sizes.append(links.select("a_doc", "b_doc").distinct().count())
        return by_pair(links)
    monkeypatch.setattr(passages, "_by_pair", counted)
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    find = joined(got)
    assert {r.doc_id for r in got} | {r.match_id for r in got} == {40, 90, 149} and find(40) == find(90) == find(149)
    assert sum(sizes) < 3 * len(rows), sizes


def test_no_similar_stretch_is_ruled_out():
    """Bounds against all stretches, for texts of many and of few words."""
    rng, similar = np.random.default_rng(5), 0
    for trial in range(300):
        a = rng.integers(0, (4, 12, 1000)[trial % 3], 22)
        b = np.concatenate((rng.integers(0, 1000, 3), a[2:20]))
        b[rng.integers(0, len(b), 2)] = -1
        spans = lambda x: [(i, k) for i in range(len(x) - 11) for k in range(i + 12, len(x) + 1)]
        ends = [(x, y, p, q) for x, y in spans(a) for p, q in spans(b) if x <= 11 < y and p <= 12 < q]
        if any(len(set(a[x:y]) & set(b[p:q])) >= 0.8 * len(set(a[x:y]) | set(b[p:q])) for x, y, p, q in ends):
            similar += 1
            bounds = [passages._density(passages._before(x), np.isin(x, z), at, at, 12) for x, z, at in ((a, b, 11), (b, a, 12))]
            assert sum(bounds) >= 0
    assert 50 < similar < 300


@pytest.mark.parametrize("edit", ["change", "insert", "delete"])
def test_one_edit_at_any_place_is_verified(edit):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    for n in range(51, 76):
        passage = words(n)
        for at in range(n):
            other = passage[:at] + (["x"] if edit == "change" else ["x", passage[at]] if edit == "insert" else []) + passage[at + 1:]
            a = passages.shingles(" ".join(words(30) + passage + words(40)))
            b = passages.shingles(" ".join(words(60) + other + words(20)))
            found = passages.verify(a, b)
            assert len(found) == 1, (n, at)
            x, y, p, q, j = found[0]
            left, right = set(a[x:y].tolist()), set(b[p:q].tolist())
            assert min(y - x, q - p) >= passages.LEAST and j >= 0.8
            assert j == pytest.approx(len(left & right) / len(left | right))
            assert 30 - 10 <= x and y <= 30 + n + 10 and 60 - 10 <= p and q <= 60 + n + 10


def test_verification_of_texts_without_common_passages():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2 ** 60, 400).astype(np.uint64) for _ in range(2))
    b[100:135] = a[200:235]                                          # too short even when filled up
    assert passages.verify(a, b) == [] and passages.verify(a[:0], b) == [] and passages.verify(a, b[:20]) == []
    b[100:180] = a[200:280]
    b[250:300] = a[20:70]                                            # two passages in the other order
    assert sorted(v[:4] for v in passages.verify(a, b)) == [(20, 70, 250, 300), (200, 280, 100, 180)]
    loop = np.tile(a[:30], 5)                                        # repeated shingles
    assert passages.verify(np.concatenate((b[:50], loop)), np.concatenate((loop, b[:50])))


# ---- quality rules

def plain_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def floored_factor(cov):
    """Cholesky factor whose every pivot is at least its statistic's floor."""
    floors = [(f * quality_rules.SCALE) ** 2 for f in quality_rules.FLOORS.values()]
    low = np.zeros_like(cov)
    for i in range(len(cov)):
        for j in range(i + 1):
            rest = cov[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(rest, floors[i])) if i == j else rest / low[j, j]
    return low


def plain_verdicts(rows):
    """The rules in plain numpy: (doc_id, text, lang, source) -> kept flags."""
    rules = quality_rules
    counts = [plain_counts(t) for _, t, _, _ in rows]
    distinct = [len({w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w}) for _, t, _, _ in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
    passing = [k for k, f in enumerate(failed) if not f]

    def stats(c, d):
        n = max(c[0], 1)
        raw = [math.log1p(n), math.log(max(c[1], 1) / n), *[math.log1p(1000 * c[k] / n) for k in (2, 3, 4)], math.log(n / max(d, 1))]
        return [math.floor(abs(v) * rules.SCALE + 0.5) * (1 if v >= 0 else -1) for v in raw]
    x = np.array([stats(c, d) for c, d in zip(counts, distinct)], float)

    # a source with enough rows is a group; the others of a language are one,
    # and where that is too small, all rows of the language are its sample
    sizes = collections.Counter((rows[k][2], rows[k][3]) for k in passing)
    group = [(r[2], r[3]) if sizes[r[2], r[3]] >= rules.MIN_GROUP else (r[2], "the others") for r in rows]
    samples = {g: [k for k in passing if group[k] == g] for g in set(group)}
    for g, sample in samples.items():
        if g[1] == "the others" and 0 < len(sample) < rules.MIN_GROUP:
            samples[g] = [k for k in passing if rows[k][2] == g[0]]

    def distances(z, mean, low):
        return (np.linalg.solve(low, (z - mean).T) ** 2).sum(0)

    def bins_of(d2):
        return np.floor(np.log2(np.maximum(d2, 2.0 ** -10)) * rules.BINS_PER_OCTAVE)

    def estimate(z):
        middle = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
        mean = middle(z)
        low = floored_factor(np.diag((1.4826 * middle(np.abs(z - mean))) ** 2))
        for _ in range(rules.STEPS):
            bins = bins_of(distances(z, mean, low))
            near = z[bins <= max(b for b in set(bins) if (bins < b).sum() < rules.SUPPORT * len(z))]
            if len(near) < rules.SUPPORT * rules.MIN_GROUP:
                return None
            mean, low = near.mean(0), floored_factor(1.8 * np.cov(near.T, bias=True))
        roots = np.sort(2.0 ** ((bins_of(distances(z, mean, low)) + 0.5) / (3 * rules.BINS_PER_OCTAVE)))
        half, upper = roots[-(-len(z) // 2) - 1], roots[-(-3 * len(z) // 4) - 1]
        tail = (half + rules.TAIL / 0.6745 * (upper - half)) ** 3
        return mean, low, max(rules.LEAST_CUTOFF, min(rules.CUTOFF, tail))

    fitted = {g: estimate(x[sample]) for g, sample in samples.items() if sample}
    kept = []
    for k, g in enumerate(group):
        found = fitted.get(g)
        far = found is not None and distances(x[k:k + 1], *found[:2])[0] > found[2]
        kept.append(not failed[k] and not far)
    return counts, failed, kept


SF_MIDDLE, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.mark.parametrize("where", ["small", SF_SMALL, SF_MIDDLE, SF_LARGE])
def test_quality_rules_query(spark, small, where):
    root = small if where == "small" else where
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    counts, failed, kept = plain_verdicts(rows)
    got = registry.queries()["op9_quality_rules"](spark, root).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(
        (r[0], *c, f, k) for r, c, f, k in zip(rows, counts, failed, kept))
    assert 0 < sum(kept) < len(kept)
    if where == SF_LARGE:       # sources are judged on their own there, and more than the base rules reject
        assert sum(n >= quality_rules.MIN_GROUP for n in collections.Counter((r[2], r[3]) for r in rows).values()) > 20
        assert sum(kept) < len(rows) - sum(failed)


def test_outliers_go_and_layout_does_not_matter(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 300))), "en", "web") for i in range(120)]
    rows += [(900, "## $$ && " * 30 + " ".join(vocabulary[:90]), "en", "web"), (901, " ".join(w * 9 for w in vocabulary[:120]), "en", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = {r.doc_id: (r.kept, r.d2) for r in quality_rules.quality_rules(df, keep=("doc_id",)).select("row.doc_id", "kept", "d2").collect()}
    two = {r.doc_id: (r.kept, r.d2) for r in quality_rules.quality_rules(df.repartition(7), keep=("doc_id",)).select("row.doc_id", "kept", "d2").collect()}
    assert one == two
    assert [i for i, (k, _) in one.items() if not k] == [900, 901]


@pytest.mark.parametrize("statistic,counts", [
    ("t_len", {"n_words": 20_000, "n_distinct": 14_000, "word_chars": 100_000}),
    ("t_word", {"word_chars": 4000}),
    ("t_sym", {"n_symbols": 400}),
    ("t_dup", {"n_dup_lines": 58}),
    ("t_rep", {"n_repeat_words": 59}),
    ("t_rich", {"n_distinct": 12}),
])
def test_an_outlier_in_one_statistic_goes(spark, statistic, counts):
    rng = random.Random(13)
    rows = []
    for i in range(200):
        n = rng.randint(150, 260)
        # a few clean rows have a repeated line
        rows.append((i, n, n * rng.randint(66, 74) // 100, n * rng.randint(48, 52) // 10, 0, int(i % 40 == 0), 0))
    base = {"doc_id": 900, "n_words": 200, "n_distinct": 140, "word_chars": 1000, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0}
    rows += [tuple(base.values()), tuple({**base, "doc_id": 901, **counts}.values())]
    stats = spark.createDataFrame([(*r, "en", "web", False) for r in rows], ", ".join(
        [f"{c} long" for c in base] + ["g_lang string", "g_source string", "g_pooled boolean"]))
    got = {r.doc_id: r for r in quality_rules.judge(stats, quality_rules.fit(stats)).collect()}
    assert not got[901].base_failed and [i for i, r in got.items() if not r.kept] == [901]
    # alone beyond the highest cut-off any group can have
    assert got[901].d2 > quality_rules.CUTOFF and got[900].d2 < quality_rules.LEAST_CUTOFF


@pytest.mark.parametrize("lang", ["en", None])
def test_small_sources_are_judged_by_their_language(spark, lang):
    rng = random.Random(15)
    rows = []
    for i in range(200):
        n = rng.randint(150, 260)
        rows.append((i, n, n * 7 // 10, n * 5, 0, 0, 0, lang, "web" if i < 194 else "tiny"))
    rows += [(900, 200, 140, 1000, 400, 0, 0, lang, "tiny"), (901, 200, 140, 1000, 400, 0, 0, lang, None)]
    stats = quality_rules.grouped(spark.createDataFrame(
        rows, "doc_id long, n_words long, n_distinct long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, g_lang string, g_source string"))
    got = quality_rules.judge(stats, quality_rules.fit(stats)).collect()
    assert len(got) == 202 and all(r.d2 is not None for r in got)
    assert sorted(r.doc_id for r in got if not r.kept) == [900, 901]


# ---- pipeline

def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()


def test_pipeline_against_plain_version(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    kept = [r for r, k in zip(rows, plain_verdicts(rows)[2]) if k]
    named = plain_components([(r[0], plain_fingerprint(r[1])) for r in kept])
    one = {}
    for r, c in zip(kept, named):
        if r[0] == c or (r[0] is None and c is None):
            one[r[0]] = r                          # of repeated rows one stays
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    test = decontaminate.TestSet(items)
    left = [(r, h) for r, (_, h, *_) in zip(one.values(), decontaminate.scan([r[1] for r in one.values()], test))]
    clean = [r for r, hits in left if not hits]
    assert len(clean) < len(left) < len(kept) < len(rows)
    counts = collections.Counter((k, v, s) for r in clean for k, _, _, _, v, s in pii.candidates(r[1]))
    weights = pii.train(sorted((k, v, s, n) for (k, v, s), n in counts.items()))
    masked = {r[0]: pii.mask(r[1], pii.find(r[1], weights)[1]) for r in clean}
    assert "[EMAIL]" in masked[80] and "[CARD]" in masked[80]
    import public_tokenizers as P
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in masked.items():
        ids = encoding.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(14)
    x, y, z, v, n = (" ".join(f"w{rng.getrandbits(32):x}" for _ in range(80)) for _ in range(5))
    rows = [(5, x), (9, x),            # names x; the id is also in y's component, which 2 names
            (2, y), (5, y),
            (7, z), (7, v),            # one id with two unlinked texts
            (None, n), (None, n), (None, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.stage(spark, df, "").collect()), key=str)
    assert got == sorted([(5, x), (2, y), (7, z), (7, v), (None, n)], key=str)


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
