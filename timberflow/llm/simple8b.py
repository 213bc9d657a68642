"""Simple-8b words: 4 bits of selector and 60 bits of values.

Selector 0 stands for 240 zeros, 1 to 14 for ``counts[s]`` values of
``widths[s]`` bits (the first value lowest), 15 for one value of up to 64 bits
in the word that follows (the escape).
"""

from __future__ import annotations

import numpy as np

# Fixed values of the word format.
COUNTS = (240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64)
ESCAPE = 15


def pack(values: np.ndarray) -> np.ndarray:
    """Words for the values, each word as full as it gets from left to right."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    bits = np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), values, side="right").astype(np.uint8)
    spans = {1: np.concatenate([bits, np.zeros(COUNTS[0], np.uint8)])}  # widest of so many values
    size = 1
    while size * 2 <= COUNTS[0]:
        last = spans[size]
        spans[size * 2] = np.maximum(last[:-size], last[size:])
        size *= 2
    best = np.full(n, ESCAPE, np.int64)
    for s in range(ESCAPE - 1, -1, -1):
        size = 1 << (COUNTS[s].bit_length() - 1)
        widest = np.maximum(spans[size][:n], spans[size][COUNTS[s] - size : COUNTS[s] - size + n])
        best[widest <= WIDTHS[s]] = s
    step = np.array(COUNTS)[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts)
    chosen = best[first]
    place = np.arange(len(first)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    out = np.zeros(len(first) + int((chosen == ESCAPE).sum()), np.uint64)
    out[place] = chosen.astype(np.uint64)
    padded = np.concatenate([values, np.zeros(COUNTS[0], np.uint64)])
    for s in np.unique(chosen).tolist():
        at = chosen == s
        if s == ESCAPE:
            out[place[at] + 1] = values[first[at]]
        elif s:
            for j in range(COUNTS[s]):
                out[place[at]] |= padded[first[at] + j] << np.uint64(4 + j * WIDTHS[s])
    return out


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values; whole groups of equal selectors at a time."""
    selector = (words & np.uint64(15)).astype(np.int64)
    real = np.ones(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE).tolist():  # a raw word may look like an escape
        if real[at] and at + 1 < len(words):
            real[at + 1] = False
    place = np.flatnonzero(real)
    selector = selector[place]
    count = np.array(COUNTS)[selector]
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), np.uint64)
    for s in np.unique(selector).tolist():
        at = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[first[at]] = words[place[at] + 1]
        elif s:
            body, mask = words[place[at]] >> np.uint64(4), np.uint64((1 << WIDTHS[s]) - 1)
            for j in range(COUNTS[s]):
                out[first[at] + j] = (body >> np.uint64(j * WIDTHS[s])) & mask
    return out[:n]
