"""Windows of one key compared in cells: few verifications, sound bounds."""

import numpy as np

from martlet.llm import passages


def cell(texts, key, doc=None, settled=None):
    """Columns of a cell: the windows of each text are where ``key`` is."""
    contexts, place, last = [], [], []
    for text in texts:
        words = text.split()
        at = [i for i in range(len(words) - 4) if words[i:i + 5] == key.split()]
        contexts.append((passages.shingles(text) >> np.uint64(32)).astype(np.uint32).view(np.int32))
        place.append(at[0])
        last.append(at[-1])
    n = len(texts)
    return (np.arange(n) if doc is None else np.array(doc), np.arange(n), np.zeros(n, bool) if settled is None else np.array(settled),
            np.zeros(n, np.int64), np.array(place), np.array(last), contexts)


def counted(monkeypatch, name):
    calls, plain = [], getattr(passages, name)

    def count(*x, **named):
        calls.append(1)
        return plain(*x, **named)
    monkeypatch.setattr(passages, name, count)
    return calls


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_equal_passages_of_few_words_are_joined_unverified(monkeypatch):
    """80 documents say one word 50 times and more, 40 say it less often, all
    between runs of other words."""
    runs = [50 + k % 15 for k in range(80)] + [20 + k % 25 for k in range(40)]
    texts = [" ".join([f"l{k}"] * 40 + ["the"] * n + [f"r{k}"] * 40) for k, n in enumerate(runs)]
    calls = counted(monkeypatch, "verify")
    pairs = passages._cell_pairs(*cell(texts, "the the the the the"))
    root = roots(len(texts), pairs)
    assert len({root[k] for k in range(80)}) == 1 and len(set(root)) == 41
    assert len(calls) <= 8 and len(pairs) <= 3 * 80, (len(calls), len(pairs))


def test_a_window_similar_to_no_copy_is_not_compared_with_each(monkeypatch):
    """150 near copies that a representative joins, and 30 texts that hold a
    line of them and of the rest all but every tenth word."""
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    before, line, after = words(60), words(14), words(60)
    copies = []
    for _ in range(150):
        copy = before + line + after
        copy[int(rng.integers(0, 40))] = "changed"
        copies.append(copy)
    noisy = lambda x: [words(1)[0] if k % 10 == 9 else w for k, w in enumerate(x)]
    texts = [" ".join(x) for x in copies + [noisy(before) + line + noisy(after) for _ in range(30)]]
    columns = list(cell(texts, " ".join(line[4:9]), settled=[True] * 150 + [False] * 30))
    columns[1][:150] = 0                                    # one class
    single, checked = counted(monkeypatch, "_density"), counted(monkeypatch, "verify")
    assert passages._cell_pairs(*columns) == []
    assert len(single) + len(checked) < 180
    texts[-1] = " ".join(before[:-1] + ["x"] + line + after)     # now one is similar to them
    columns[-1][-1] = cell(texts[-1:], " ".join(line[4:9]))[-1][0]
    pairs = passages._cell_pairs(*columns)
    assert pairs and all(j == 179 for _, j in pairs)


def test_bounds_of_many_rows_are_those_of_one():
    rng, hits = np.random.default_rng(8), 0
    for trial in range(60):
        base = rng.integers(0, 1 << 30, 120).astype(np.int32)
        rows = []
        for _ in range(8):
            x = base[rng.integers(0, 20):120 - rng.integers(0, 20)].copy()
            for at in rng.integers(0, len(x) - 5, rng.integers(0, 6)):
                x[at:at + 5] = rng.integers(0, 1 << 30, 5)
            if trial % 3 == 0:
                x[10:30] = x[10]                            # repeated shingles
            rows.append(x)
        place, last = np.full(8, 40), np.full(8, 44)
        around = passages._Surroundings(rows, [passages._before(x) for x in rows], place, last)
        a, b = (x.ravel() for x in np.indices((8, 8)))
        a, b = a[a < b], b[a < b]
        possible, alone = around.possible(a, b, np.full(len(a), 200)), around.alone(np.arange(8))
        for x, y, may in zip(a.tolist(), b.tolist(), possible.tolist()):
            one = sum(passages._density(passages._before(rows[i]), np.isin(rows[i], rows[j]), 40, 44) for i, j in ((x, y), (y, x)))
            if around.plain[x] and around.plain[y]:
                assert may == (one >= 0) or abs(one) < 0.01
            found = [m for m in passages.verify(rows[x], rows[y]) if m[0] <= 44 and m[1] > 40 and m[2] <= 44 and m[3] > 40]
            if found:
                hits += 1
                assert may and around.pair_possible(x, y) and not alone[x] and not alone[y]
    assert hits > 50


def test_a_word_that_goes_on_belongs_to_the_passage():
    long, short = (passages.shingles(" ".join(["a"] * 7 + ["of"] * n + ["b"] * 7)) for n in (92, 58))
    for a, b, sides in ((long, short, (0, 2)), (short, long, (2, 0))):
        (found,) = passages.verify(a, b)
        for begin, n in zip(sides, (92, 58)):
            assert found[begin] <= 7 and found[begin + 1] >= 7 + n - 4
        assert found[4] == passages._jaccard(*(x for x in passages._numbered(a[found[0]:found[1]], b[found[2]:found[3]])))
