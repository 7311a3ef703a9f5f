"""Main text of web pages by consensus host paths.

Method: every page scores its containers; the scores vote, per host and in
Spark, on generalised tag-class paths; pages are then extracted again from the
containers at their host's winning path.

* Scoring and extraction are Arrow passes over whole pages. Votes are integer
  shares of a page's score, so their sums do not depend on task order.
* Votes are summed per (host, path) with map-side partial sums: a host with a
  third of all pages costs a row per task and path. Winners are a written
  table with a row per host; whether it is broadcast is left to Spark's byte
  threshold, beyond which AQE splits a hot host.
* Parsing is a single scan with an element stack that never backs up and is
  never walked: where a tag was opened last, and where the last container, is
  kept beside it. Paths are numbers (parent path, label) with a digest each, and
  texts look for containers only, so time and memory follow the page's size,
  however deep it is nested. Paths of over ``DEEP`` steps are written as their
  last steps and the digest of the whole.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined in page order by one space. Left out are menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by element or by the words of class, id and role. Words never
leave out an article, unless it lies in another one as reader comments do; in
articles and main, headers stay and ids of headings and paragraphs, which are
mostly made from their text, say nothing.

Edge cases: NULL and empty pages give an empty text; a page without its host's
path uses its own best container; a NULL or odd url votes under the empty
host; a page without containers is its body; rows repeat as given.
"""

from __future__ import annotations

import hashlib
import html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, materialise, table

_TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body div main section td center blockquote".split())
#: Elements that never belong to the main text.
OUT_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
#: Words of class, id or role that mark boilerplate.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies disclaimer dropdown footer gdpr header masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promoted related share sharing sidebar signup skip "
    "social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search".split())
#: Elements whose id says nothing inside a landmark.
SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that are never boilerplate by their class words alone.
WHOLE = frozenset("html body main".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag closes the open elements of its set up to the given limits.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
            "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
LANDMARKS = frozenset(["article", "main"])
DEEP = 64


def tag_end(source: str, at: int) -> int:
    """Place of the ``>`` that ends the tag around ``at``, or -1. Only a quote
    after ``=`` opens a value; one that is never closed counts as a character."""
    begin = at
    while m := _STOP.search(source, at):
        if m.group() == ">":
            return m.start()
        at = m.end()
        if source[begin:m.start()].rstrip().endswith("="):
            close = source.find(m.group(), at)
            if close < 0:
                return source.find(">", at)
            at = begin = close + 1
    return -1


class Page:
    """Elements and text of one page: nodes are (parent, tag, path, out, first
    text, last text, nearest container), texts are (node, string, inside a
    link); a break is (-1, " ", _)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.out = [-1], ["#"], [0], [False]
        self.first, self.last, self.container = [0], [0], [-1]
        # paths: (parent path, label) by number, with steps and digest
        self.steps: list[tuple[int, str, int, bytes]] = [(-1, "", 0, b"")]
        self.number: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, str, bool]] = []
        self._parse(source)

    def _path(self, up: int, label: str) -> int:
        """The number of the path that goes on from ``up``."""
        found = self.number.get((up, label))
        if found is None:
            found = self.number[up, label] = len(self.steps)
            _, _, depth, digest = self.steps[up]
            self.steps.append((up, label, depth + 1, hashlib.blake2b(digest + b"/" + label.encode(), digest_size=12).digest()))
        return found

    def path_text(self, path: int) -> str:
        _, _, depth, digest = self.steps[path]
        labels = []
        while path and len(labels) < DEEP:
            path, label, _, _ = self.steps[path]
            labels.append(label)
        labels.append("" if depth <= DEEP else f"~{digest.hex()}")
        return "/".join(reversed(labels))

    def _open(self, up: int, tag: str, attrs: str, open_at: dict[str, list[int]]) -> int:
        words, label = set(), tag
        inside = any(open_at.get(t) for t in LANDMARKS)
        if attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                found = [w.lower() for w in _WORDS.findall(value)]
                if not (inside and tag in SLUGGED and name.lower() == "id"):
                    words.update(found)
                if name.lower() == "class":
                    label = tag + "".join("." + w for w in sorted(set(found)))
        if inside:
            words.discard("header")
        whole = tag in WHOLE or (tag == "article" and not open_at.get("article"))
        out = self.out[up] or tag in OUT_TAGS or (tag == "header" and not inside) or (
            not whole and not OUT_WORDS.isdisjoint(words))
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self._path(self.path[up], label) if tag not in INLINE else self.path[up])
        self.out.append(out)
        self.first.append(len(self.texts))
        self.last.append(len(self.texts))
        node = len(self.parent) - 1
        self.container.append(node if tag in CONTAINERS else self.container[up])
        return node

    def _parse(self, source: str) -> None:
        stack, at, n, links = [0], 0, len(source), 0
        texts, low = self.texts, None
        open_at: dict[str, list[int]] = {}      # places in the stack, per tag
        containers: list[int] = []              # and of containers
        last = lambda tags: max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

        def close(upto: int) -> None:
            nonlocal links
            while len(stack) > upto:
                node = stack.pop()
                self.last[node] = len(texts)
                tag = self.tag[node]
                links -= tag == "a"
                if node:
                    open_at[tag].pop()
                    if tag in CONTAINERS:
                        containers.pop()

        while at < n:
            m = _TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                texts.append((stack[-1], source[at:begin], links > 0))
            if not m:
                break
            at = m.end()
            name = m.group(2)
            if name is None:
                comment = source.startswith("<!--", begin)
                end = source.find("-->" if comment else ">", at)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            tag = name.lower()
            end = tag_end(source, at)
            if end < 0:
                break                   # cut inside a tag
            attrs, at = source[at:end], end + 1
            if m.group(1):
                found = last((tag,))
                if found and not (tag in INLINE and containers and containers[-1] > found):
                    close(found)
                if tag not in INLINE and tag not in RAW:
                    texts.append((-1, " ", False))
                continue
            if tag in RAW:
                if low is None:
                    low = source.lower() if len(source.lower()) == n else source
                end = low.find(f"</{tag}", at)
                if not attrs.endswith("/"):
                    at = n if end < 0 else end
                continue
            if tag not in INLINE:
                texts.append((-1, " ", False))
            if tag in VOID or attrs.endswith("/") and tag not in CONTAINERS:
                continue
            if tag in CLOSES_P:
                found = last(("p",))
                if found > (containers[-1] if containers else 0):
                    close(found)
            if tag in SIBLINGS:
                same, limit = SIBLINGS[tag]
                found = last(same)
                if found > last(limit):
                    close(found)
            node = self._open(stack[-1], tag, attrs, open_at)
            open_at.setdefault(tag, []).append(len(stack))
            if tag in CONTAINERS:
                containers.append(len(stack))
            stack.append(node)
            links += tag == "a"
        close(0)

    def scores(self) -> dict[int, int]:
        """Characters of running text per container: a text counts in full for
        its nearest container, by half for the next, and so on; link text counts
        against it. Landmark elements count double."""
        got: dict[int, int] = {}
        for node, text, link in self.texts:
            if node < 0 or self.out[node]:
                continue
            size = len(text) - text.count(" ") if link else len(text)
            if not text.strip():
                continue
            weight = -2 * size if link else 2 * size
            node = self.container[node]
            while node > 0 and weight:
                got[node] = got.get(node, 0) + (2 * weight if self.tag[node] in LANDMARKS else weight)
                weight = weight // 2 if weight > 0 else -(-weight // 2)
                node = self.container[self.parent[node]]
        return got

    def votes(self) -> dict[str, int]:
        """Thousandths of the page's score per path (its best node counts)."""
        best: dict[int, int] = {}
        for node, score in self.scores().items():
            if score > 0:
                best[self.path[node]] = max(best.get(self.path[node], 0), score)
        total = sum(best.values())
        return {self.path_text(p): 1000 * s // total for p, s in best.items()} if total else {}

    def text(self, path: str | None) -> str:
        """Main text from the nodes at ``path``, else from the best node."""
        steps = path.count("/") if path else 0
        alike = {p for p in set(self.path) if path and (self.steps[p][2] == steps or steps >= DEEP < self.steps[p][2])
                 and self.path_text(p) == path}
        nodes = [i for i in range(1, len(self.path)) if self.path[i] in alike and not self.out[i]
                 and self.tag[i] in CONTAINERS]
        if not any(self.last[i] > self.first[i] for i in nodes):
            scores = self.scores()
            nodes = [min(scores, key=lambda i: (-scores[i], i))] if scores else [0]
        parts, upto = [], 0
        for i in nodes:
            for node, text, _ in self.texts[max(upto, self.first[i]):self.last[i]]:
                if node < 0 or not self.out[node]:
                    parts.append(html.unescape(text) if "&" in text else text)
            parts.append(" ")
            upto = max(upto, self.last[i])
        return " ".join("".join(parts).split())


def host(url: str) -> F.Column:
    """Lower-case host of a url, empty where there is none."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


VOTES = T.StructType([T.StructField("votes", T.ArrayType(T.StructType([
    T.StructField("path", T.StringType()), T.StructField("score", T.LongType())])))])


def winning_paths(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """``host, path`` with the most votes (ties: the lesser path)."""
    def start():
        def run(texts):
            return [[[{"path": p, "score": s} for p, s in Page(t).votes().items()] if t else []
                     for t in texts.to_pylist()]]
        return run
    rows = pages.select(host(url).alias("host"), F.col(markup).alias("html"))
    votes = (map_columns(rows, ["html"], ["host"], VOTES, start)
             .select("host", F.explode("votes").alias("v"))
             .groupBy("host", F.col("v.path").alias("path")).agg(F.sum("v.score").alias("score")))
    return votes.groupBy("host").agg(F.min_by("path", F.struct((-F.col("score")).alias("s"), "path")).alias("path"))


def extract(pages: DataFrame, keep: tuple[str, ...], url: str = "url", markup: str = "html") -> DataFrame:
    """``keep`` columns and ``text``, the main text of every page."""
    paths = materialise(winning_paths(pages, url, markup), "host-paths").withColumnsRenamed(
        {"host": "w_host", "path": "w_path"})
    rows = pages.select(F.struct(*keep).alias("row"), host(url).alias("p_host"), F.col(markup).alias("p_html"))
    joined = rows.join(paths, F.col("p_host") == F.col("w_host"), "left")

    def start():
        def run(texts, chosen):
            return [[Page(t).text(p) if t else "" for t, p in zip(texts.to_pylist(), chosen.to_pylist())]]
        return run
    return map_columns(joined, ["p_html", "w_path"], ["row"],
                       T.StructType([T.StructField("text", T.StringType())]), start).select("row.*", "text")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages", "page_id", "url", "html"), ("page_id", "url"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
