"""A small set of tables with every awkward case, shared by the operator tests."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SF_SMALL = "/root/testdata/sf0.001"
SYLLABLES = "an be cor da el fi gan ho il jo ka lu mi no or pe qua ri so ta un ve wi xo ys zu".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def prose(rng, n_lines=6, n_words=14):
    return "\n".join(sentence(rng, n_words).capitalize() + "." for _ in range(n_lines))


def make_documents():
    rng = random.Random(7)
    passage = sentence(rng, 70)
    item = sentence(rng, 24)
    texts = {}
    for i in range(1, 71):
        texts[i] = prose(rng)
    texts[71] = texts[3]                                              # exact copies
    texts[72] = texts[3].upper()
    texts[73] = texts[4].replace("\n", " \t ")                        # same words
    texts[74] = " ".join(texts[5].split()[:-1] + ["other"])           # near copy
    for i in (75, 76, 77):                                            # one passage in three documents
        texts[i] = prose(rng, 2) + "\n" + passage + "\n" + prose(rng, 2)
    words = passage.split()
    words[30] = "changed"
    texts[78] = prose(rng, 2) + " " + " ".join(words) + " " + prose(rng, 2)
    texts[79] = prose(rng, 3) + " " + item + " " + prose(rng, 3)      # benchmark text inside
    texts[80] = "Mail jo.doe@mail.example.com or call +1 (415) 555-0134, host 10.20.30.40, card 4111 1111 1111 1111. " + prose(rng)
    texts[81] = "### *** $$$ " * 40                                   # junk
    texts[82] = sentence(rng, 9) + " " + " ".join([sentence(rng, 12)] * 9)
    texts[83] = ""
    texts[84] = None
    texts[85] = " \n\t \x0b\x0c\r "
    texts[86] = "one"
    texts[87] = " ".join(sentence(rng, 50) for _ in range(400))       # 20,000 words
    texts[88] = "naïve façade 漢字 😀 <|endoftext|> don't 12345 á  x \x1c y  z"
    texts[89] = "a" * 5000
    ids = list(texts) + [10, 10, None]                                # repeated rows, a row without id
    body = list(texts.values()) + [texts[10], texts[10], prose(rng)]
    lang = [None if i == 20 else "en" if (i or 0) % 9 else "de" for i in ids]
    source = [None if i == 21 else f"s{(i or 0) % 13 // 12}" for i in ids]
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(body, pa.string()), "lang": lang,
                      "source": source, "n_chars": pa.array([None if t is None else len(t) for t in body], pa.int64())})
    bench = pa.table({"item_id": pa.array([1, 2, 3, 10, 4], pa.int64()),
                      "text": pa.array([item, sentence(rng, 30), "Qqq!", item, None], pa.string())})
    # clashing extra columns
    for name in ("row", "text_", "fp", "kept", "spans", "ids", "word", "n_words", "component_id"):
        table = table.append_column(name, pa.array(["x"] * table.num_rows))
    return table, bench


def make_pages():
    article = "<article><h1>T{0}</h1><p>First &amp; <b>bold</b>er {0}.<p>Second<br>line{0}</article>"
    pages = [(i, f"https://www.host{i % 3}.example/{i}",
              "<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body>"
              "<nav><ul><li><a href='/a'>menu</a></li></ul></nav><div class=\"ad banner\">buy</div>"
              + article.format(i) + "<div class='comments'><p>nice</p></div><footer>&copy; me</footer></body></html>")
             for i in range(1, 13)]
    pages += [(13, pages[0][1], pages[0][2]), (14, "https://x.example", pages[0][2]), (15, None, ""), (16, "odd", None),
              (17, "https://www.host0.example/t", "<div><p>cut off <b>here"), (18, "u", "z" * 700_000)]
    return pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": [p[1] for p in pages],
                     "html": pa.array([p[2] for p in pages], pa.string())})


def make_conversations():
    """Bases that are missing, short or long; ties, NULLs and repeated rows; a
    conversation of many turns; copies; a first turn that most share."""
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 240), 300, 301, 399, -7, -100, -101]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 13]) if c != 100 else 2):
            text = "hello" if t == 0 and c % 3 else rng.choice(["x", "yy", "", None, "z\U0001F600 e\u0301"])
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "assistant", None]), text))
    rows += [(55, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += rows[:9] + [(None, 0, "user", "nobody"), (None, None, None, None)]
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()),
                      "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    for name in ("depth", "turn_key", "k1", "n_convs", "own"):
        table = table.append_column(name, pa.array(["x"] * table.num_rows))
    return table


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    root = tmp_path_factory.mktemp("llm-tables")
    docs, bench = make_documents()
    labels = pa.table({"doc_id": pa.array([*range(1, 71), 81, 82], pa.int64()),
                       "quality": pa.array([1] * 70 + [0, 0], pa.int32()), "toxic": pa.array([0] * 72, pa.int32())})
    for name, table in (("documents", docs), ("benchmark", bench), ("pages", make_pages()), ("labels", labels),
                        ("conversations", make_conversations())):
        pq.write_table(table, f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    root = tmp_path_factory.mktemp("llm-empty")
    docs, bench = make_documents()
    labels = pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())})
    for name, table in (("documents", docs.slice(0, 0)), ("benchmark", bench.slice(0, 0)),
                        ("pages", make_pages().slice(0, 0)), ("labels", labels),
                        ("conversations", make_conversations().slice(0, 0))):
        pq.write_table(table, f"{root}/{name}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def texts(small):
    """(doc_id, text) of every row."""
    t = pq.read_table(f"{small}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"]))
