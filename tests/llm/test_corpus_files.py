"""Source divergence, token files and the conversation trie."""

import array
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from llm_cases import SF_SMALL, empty, small, texts  # noqa: F401
from martlet.llm import divergence, parts, prefix_trie, simple8b, token_ids
from martlet.session import scratch_path


# ---- source divergence

def plain_audit(rows, least=10, top=10):
    """Every group against every kept term, with Python's integers."""
    word = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = word.findall((text or "").translate(lower))
        count[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = [s for x, s in count if x == lang]

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}
        shares = {s: share(count[lang, s]) for s in groups}
        whole = share(sum((count[lang, s] for s in groups), collections.Counter()))
        for s in groups:
            pair = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(shares[s][t], whole[t]), t) for t in kept if count[lang, s][t] and shares[s][t] > whole[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(items, 1) if part == "pair" or r <= top}
    return out


def random_documents(rng, n=400):
    words = ["Alpha", "beta", "GAMMA", "naïve", "漢字", "ÉTÉ", "été", "x1y", "don't", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "B", "é", "rare" if i % 50 == 0 else "c"])
        pool = words if source != "b" else words[:12]
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) + rng.choice(["", "\n", "123", "_"])
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "en", "de", None]), source))
    return rows + [("only one", "xx", "s"), (None, "yy", "s"), (None, "yy", "t")]


@pytest.mark.parametrize("most, segment", [(400_000, 1024), (50, 3)])
def test_audit_equals_brute_force(spark, monkeypatch, most, segment):
    rows = random_documents(random.Random(most))
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    made = divergence.frequencies
    monkeypatch.setattr(divergence, "frequencies", lambda d, least: made(d, least, most, segment))
    got = divergence.audit(df).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain_audit(rows)


def test_pair_sums_in_slices(spark, monkeypatch):
    """A term of very many groups is dealt out in slices, sums are handed on early."""
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["one", "two", "three", f"own{chr(97 + g % 26)}"], k=9)), "en", f"s{g}") for g in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    made = divergence.corrections
    monkeypatch.setattr(divergence, "corrections", lambda of: made(of, 7, 50))
    assert {tuple(r) for r in divergence.audit(df).collect()} == plain_audit(rows)


def test_shares_stay_exact_for_large_counts(spark):
    big = 3 * 10 ** 13
    got = spark.sql(f"SELECT {big}L AS n, {big + 5}L AS total, 7L AS v").select(divergence._share("n", "total", "v")).first()[0]
    assert got == 1 + 10 ** 9 * (big + 2) // (big + 5 + 14)


def test_runs_merge_as_a_stream():
    rng = random.Random(4)
    blocks, plain = [], collections.Counter()
    for _ in range(5):
        block = divergence.Block()
        for _ in range(30):
            text = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(20))
            block.add(("en", rng.choice("xy")), text.encode())
            plain.update(text.split())
        blocks += block.run(4)
    names = divergence.RUNS.fieldNames()
    rows = sorted((dict(zip(names, r)) for r in blocks), key=lambda r: (r["shard"], r["lang"], r["first"]))
    merged = list(divergence.merged(iter(rows)))
    assert {w.decode(): sum(by.values()) for _, w, _, by in merged if w != divergence.GROUP} == plain
    assert len({w for _, w, _, _ in merged}) == len(merged)


# ---- token files

@pytest.mark.parametrize("values", [
    [], [0] * 1000, [0] * 119 + [7] + [0] * 121, [1 << 63, 5, (1 << 64) - 1, (1 << 60) - 1, 1 << 60, 0], [1] * 59 + [2] * 31,
    [random.Random(1).randrange(1 << b) for b in range(1, 65) for _ in range(40)]])
def test_simple8b_round_trip(values):
    words, escapes = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, escapes).tolist() == values
    assert len(words) <= max(1, len(values)) if values else not len(words)


def test_simple8b_fills_its_words():
    words, escapes = simple8b.pack(np.ones(600, np.uint64))
    assert len(words) == 10 and not len(escapes)
    words, escapes = simple8b.pack(np.array([1 << 62, 3], np.uint64))
    assert escapes.tolist() == [1 << 62] and (words >> np.uint64(60)).tolist()[0] == simple8b.ESCAPE


AWKWARD = ["", None, " a", "a ", "a\n\nb", "x <|endoftext|> y<|endoftext|>z\n<|endoftext|>", "a\tb c\t d", "\n", " ", " \n\t",
           "naïve 漢字 😀 don't 12345 á  x \x1c y z  q w", "a\n'sfoo 'll b\n 9", "<|endoftext|>", "word. word, Word.\nword,", "a" * 3000]


@pytest.fixture(scope="module")
def tokens():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_ids.encoder(path), token_ids.tokenizer(path)


def test_parts_give_the_library_ids(tokens):
    coder, library = tokens
    rng = random.Random(8)
    pieces = ["ab", "Cd.", "é", " ", "  ", "\n", "\n\n", "\t", ",", "'s", "12", "<|endoftext|>", "漢", "x,y", "\r\n", " "]
    some = AWKWARD + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    for at in range(0, len(some), 100):
        ids, counts = coder.encode(pa.array(some[at:at + 100], pa.string()))
        edges = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(ids, edges)] == [library.encode(t or "", add_special_tokens=False).ids for t in some[at:at + 100]]


def test_small_caches_change_nothing(tokens):
    _, library = tokens
    coder = parts.Encoder(lambda p: [array.array("i", library.encode(x, add_special_tokens=False).ids).tobytes() for x in p], 8)
    some = ["the cat. The dog,\nthe cat and the dog.", "a b c d e f g h i j k. a b,"] * 5
    ids, counts = coder.encode(pa.array(some))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in some]


def plain_tokens(library, rows):
    out, at = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(array.array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_token_query(spark, small, tokens):
    for root in (small, SF_SMALL):
        table = pq.read_table(f"{root}/documents.parquet").to_pydict()
        rows = sorted(zip(table["doc_id"], table["text"]), key=lambda r: (r[0] is not None, r[0]))
        got = sorted((tuple(r) for r in token_ids.op12_token_ids(spark, root).collect()), key=lambda r: r[1])
        want = plain_tokens(tokens[1], rows)
        # rows of one id come in the order of their texts' hashes
        assert [r[0] for r in got] == [r[0] for r in want]
        assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want)
        starts = np.cumsum([0] + [r[2] for r in got]).tolist()
        assert [r[1] for r in got] == starts[:-1]
        once = {i for i, n in collections.Counter(r[0] for r in want).items() if n == 1}
        assert {r[0]: r[3] for r in got if r[0] in once} == {r[0]: r[3] for r in want if r[0] in once}


def test_files_are_read_back_whole(spark, tokens):
    rows = [(5, "b b"), (None, "n"), (3, None), (3, ""), (1, "x  y"), (1, "x  y"), (2, "one two " * 40000)]
    folder = scratch_path(spark, "ids")
    manifest = token_ids.write(spark.createDataFrame(rows, "doc_id long, text string"), folder)
    back = sorted(token_ids.read(manifest, folder, content=True).collect(), key=lambda r: r.start)
    want = {t: [*tokens[1].encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    assert [(r.doc_id, list(r.ids)) for r in back] == [
        (None, want["n"]), *[(1, want["x  y"])] * 2, (2, want[rows[6][1]]), (3, [0]), (3, [0]), (5, want["b b"])]
    assert want[rows[6][1]] and len(want[rows[6][1]]) > token_ids.BLOCK      # a document over several blocks


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_any_place_is_read_from_its_blocks():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 3 * token_ids.BLOCK + 77).astype(np.uint64)
    ids[5] = 1 << 63
    counts = np.array([10, 0, len(ids) - 11, 1])
    out = File()
    writer = token_ids.Writer(out)
    writer.add(np.array([1, 2]), np.array([True, False]), ids[:10], counts[:2])
    writer.add(np.array([3, 4]), np.array([True, True]), ids[10:], counts[2:])
    assert writer.close() == 4
    reader = token_ids.Reader(out)
    assert [np.concatenate([*runs, np.empty(0, np.uint64)]).tolist() for _, _, runs in reader.documents()] == [
        x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    for start, n in ((0, 1), (5, 1), (token_ids.BLOCK - 1, 2), (token_ids.BLOCK, 2 * token_ids.BLOCK), (len(ids) - 1, 1), (9, 0)):
        assert reader.ids(start, n).tolist() == ids[start:start + n].tolist()
    for broken in (out.getvalue()[:-1], b"x" + out.getvalue()[1:]):
        with pytest.raises(ValueError):
            token_ids.Reader(File(broken))


# ---- conversation trie

def plain_trie(rows):
    """The definition: every prefix of every rebuilt conversation."""
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, children = collections.defaultdict(list), collections.Counter()
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]] += 1
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return collections.Counter(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(s)).encode()).hexdigest())
        for s, m in members.items())


def test_trie_equals_the_definition(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = prefix_trie.op13_conversation_trie(spark, small).collect()
    assert collections.Counter(map(tuple, got)) == plain_trie(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_any_length_give_the_same_nodes(spark, small, monkeypatch, block):
    want = collections.Counter(map(tuple, prefix_trie.op13_conversation_trie(spark, small).collect()))
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    cut = prefix_trie._cut

    def with_block(batches):            # the setting reaches the workers with the function
        prefix_trie.BLOCK = block
        return cut(batches)
    monkeypatch.setattr(prefix_trie, "_cut", with_block)
    assert collections.Counter(map(tuple, prefix_trie.op13_conversation_trie(spark, small).collect())) == want


def test_many_ends_at_one_node(spark, monkeypatch):
    n = 3000
    rows = [(c, t, "user", f"turn {t}") for c in range(10_000, 10_000 + n) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collections.Counter(map(tuple, prefix_trie.trie(df).collect())) == plain_trie(rows)


def test_straight_blocks_are_not_compared(spark):
    """One conversation is a chain of blocks: no prefix is grouped, every turn is a node."""
    rows = [(7, t, "user", str(t)) for t in range(23)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.trie(df).collect()
    assert collections.Counter(map(tuple, got)) == plain_trie(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # crc32("207") % 6 > 1 and conversation 200 is missing: nothing is left of 207
    lone = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "gone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r)[:7] for r in prefix_trie.trie(df).collect()] == [(lone, 0, None, 1, 0, 1, 0)]
    assert collections.Counter(map(tuple, prefix_trie.trie(df).collect())) == plain_trie(rows)
