"""Simple-8b: unsigned integers in 64-bit words.

The top four bits of a word, its selector, say how many values of how many bits
the other sixty hold. Selector 0 is a run of 120 zeros; selector 1 is an escape:
the value needs more than 60 bits (or stands there by choice of the writer) and
is the next of a list kept beside the words, so that every word decodes alone
and whole blocks decode by numpy, selector by selector.
"""

from __future__ import annotations

import numpy as np

ZEROS, ESCAPE = 0, 1
# (values, bits) of the selectors from 2 on
PACKED = [(60 // b, b) for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
COUNTS = np.array([120, 1] + [n for n, _ in PACKED], np.int64)
LARGEST = np.uint64((1 << 60) - 1)


# values of a selector -> the next smaller number of values, at least half of it
_COUNTS_UP = sorted({int(n) for n in COUNTS})
_STEPS = COUNTS.astype(np.uint8)
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _best(width: np.ndarray) -> np.ndarray:
    """Per position the selector of a word that would begin there: the one of
    most values of which all fit. The widest of the next n values comes from
    two overlapping stretches of the number before n."""
    best = np.full(len(width), ESCAPE, np.int8)
    widest, before = width, 1
    bits_of = {n: (s, b) for s, (n, b) in enumerate(PACKED, 2)} | {int(COUNTS[ZEROS]): (ZEROS, 0)}
    for n in _COUNTS_UP:
        if n > len(width):
            break
        if n > before:
            shift = n - before
            widest, before = np.maximum(widest[:len(widest) - shift], widest[shift:]), n
        selector, bits = bits_of[n]
        np.copyto(best[:len(widest)], np.int8(selector), where=widest <= bits)
    return best


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escaped values), both uint64."""
    if not len(values):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    if int(values.max()) < len(_BITS):
        width = _BITS[values]
    else:
        # beyond 2^53 rounding may add a bit, which only escapes more
        width = np.frexp(np.asarray(values, np.float64))[1].astype(np.int8)
    values = np.ascontiguousarray(values, np.uint64)
    best = _best(width)
    step = _STEPS[best].tobytes()
    starts, i, n = [], 0, len(values)
    add = starts.append
    while i < n:
        add(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen).tolist():
        if selector < 2:
            continue
        count, bits = PACKED[selector - 2]
        mine = np.flatnonzero(chosen == selector)
        here = starts[mine]
        word = words[mine]
        for k in range(count):
            word |= values[here + k] << np.uint64(bits * k)
        words[mine] = word
    return words, values[starts[chosen == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of :func:`pack`, uint64."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for selector in np.unique(selectors).tolist():
        here = starts[selectors == selector]
        if selector == ESCAPE:
            out[here] = escapes
        elif selector != ZEROS:
            count, bits = PACKED[selector - 2]
            body, mask = words[selectors == selector], np.uint64((1 << bits) - 1)
            for k in range(count):
                out[here + k] = (body >> np.uint64(bits * k)) & mask
    return out
