"""Ids of many texts at once, for byte-level tokenizers whose pieces begin at
single spaces and line ends.

Where one space, or one line end, stands between two characters that are not
blank, a new piece begins there under the usual patterns, and merges never
reach over pieces. So a slice of texts is cut at these places in Arrow, equal
parts are found by a dictionary, each distinct part gets its ids once, and the
ids of the texts are gathered by numpy. Parts seen lately are kept with their
ids, up to a limit. Texts with other arrangements of blanks (two in a row, at
either end) are cut by ``regular_parts`` instead, with the same ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LINE = "\n"
MAX_PART = 64               # longer parts are not kept
_WORD_AND_MARK = re.compile("\n?[A-Za-zÀ-ÖØ-öø-ɏ]+[.,]").fullmatch


class Recent:
    """A dictionary of at most about ``size`` entries that keeps what is in
    use: when the young half is full it becomes the old half, and what is
    found in the old half moves back to the young one."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


def regular_parts(text: str) -> list[str]:
    """``text`` cut where a piece surely begins: before a space or line end
    between two characters that are not blank, and after such a line end."""
    out, start = [], 0
    for m in re.finditer(r"(?<=\S)[ \n](?=\S)", text):
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def odd(part: str) -> bool:
    """Whether a part (see :meth:`Encoder.encode`) was cut beside a blank."""
    body = part[1:] if part[:1] == LINE else part
    return not body or body[0].isspace() or body[-1].isspace()


class Encoder:
    """Whole texts to ids.

    ``many`` gives the ids of several strings as int32 bytes; each begins with
    a space or a line end, or is the start of a text.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], size: int):
        self.many, self.known = many, Recent(size)
        self.line = np.frombuffer(many([LINE])[0], np.int32)
        self.marks = {m: many([m])[0] for m in ".,"}

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts that are not known: a word with a mark is made of the
        two, and words go to the tokenizer together."""
        made: dict[str, bytes] = {}
        bodies: dict[str, None] = {}
        composed = []
        for part in parts:
            if _WORD_AND_MARK(part):
                composed.append(part)
                if self.known.get(part[:-1]) is None:
                    bodies[part[:-1]] = None
            else:
                bodies[part] = None
        todo = list(bodies)
        for part, ids in zip(todo, self.many([p if p[:1] == LINE else " " + p for p in todo])):
            made[part] = ids
        for part in composed:
            body = made.get(part[:-1])
            made[part] = (self.known.get(part[:-1]) if body is None else body) + self.marks[part[-1]]
        for part, ids in made.items():
            if len(part) <= MAX_PART:
                self.known.put(part, ids)
        return made

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); NULL is empty.

        Texts are put behind a line end, and a space before every line end
        makes each cut a space: the parts are words that follow a space, and
        words that follow a line end and keep it.
        """
        n = len(texts)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        before, between = pa.scalar(LINE, pa.large_string()), pa.scalar("", pa.large_string())
        lines = pc.replace_substring(pc.binary_join_element_wise(before, texts, between), LINE, " " + LINE)
        cut = pc.split_pattern(lines, " ")
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes, parts = coded.indices.to_numpy().copy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes[offsets[:-1]] = len(parts)                  # before the first line end: nothing
        found = list(map(self.known.young.get, parts))
        strange = np.zeros(len(parts) + 1, bool)
        missing = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self.known.get(parts[i])
            if found[i] is None:
                if odd(parts[i]):
                    strange[i] = True
                else:
                    missing.append(i)
        irregular = np.logical_or.reduceat(strange[codes], offsets[:-1])
        if missing and irregular.any():                   # parts of irregular texts alone may not be cut right
            used = np.zeros(len(parts) + 1, bool)
            used[codes[np.repeat(~irregular, np.diff(offsets))]] = True
            missing = [i for i in missing if used[i]]
        if missing:
            made = self._learn([parts[i] for i in missing])
            for i in missing:
                found[i] = made[parts[i]]
        found = [ids or b"" for ids in found]
        of_part = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(of_part) - of_part
        flat = np.frombuffer(b"".join(found), np.int32)
        of_part, start = np.append(of_part, 0), np.append(start, 0)
        length, begin = of_part[codes], start[codes]
        # the line end put in front is no part of the text
        first = offsets[:-1] + 1
        length[first] -= len(self.line)
        begin[first] += len(self.line)
        if irregular.any():
            length[np.repeat(irregular, np.diff(offsets))] = 0
        counts = np.add.reduceat(length, offsets[:-1])
        ends = np.cumsum(length)
        ids = flat[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
        if not irregular.any():
            return ids, counts
        rest = [self.one(texts[int(i)].as_py()) for i in np.flatnonzero(irregular)]
        counts[irregular] = [len(r) for r in rest]
        out = np.empty(int(counts.sum()), np.int32)
        mine = np.repeat(irregular, counts)
        out[~mine] = ids
        out[mine] = np.concatenate(rest)
        return out, counts

    def one(self, text: str) -> np.ndarray:
        """The ids of one text of any kind."""
        if not text:
            return np.empty(0, np.int32)
        parts = regular_parts(text)
        distinct = dict.fromkeys(parts)
        found = dict(zip(distinct, self.many(list(distinct))))
        return np.frombuffer(b"".join([found[p] for p in parts]), np.int32)
