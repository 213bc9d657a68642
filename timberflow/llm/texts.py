"""Whole texts as flat arrays inside Arrow batches.

A word is a run of characters other than the six ASCII white-space characters.
Null texts count as empty. Batches are cut by bytes, so one very long text is
never held together with many others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    codes: np.ndarray  # index into vocab, one per word
    offsets: np.ndarray  # words of row i: codes[offsets[i]:offsets[i + 1]]
    vocab: pa.Array


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice holds ``limit`` bytes of text or
    a single row."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def plain(column: pa.Array) -> pa.Array:
    """Strings with nulls as empty texts."""
    return pc.fill_null(column.cast(pa.string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the row boundaries in them."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return body, bounds - bounds[0]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 32


def folded(texts: pa.Array) -> pa.Array:
    """Lower case, with blanks for ASCII marks other than the apostrophe."""
    body, bounds = raw_bytes(texts)
    data = pa.py_buffer(_FOLD[body])
    plain_marks = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), data)
    return pc.utf8_lower(plain_marks)


def words(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=before[1:])
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), before[bounds - bounds[0]], coded.dictionary)


def hashes(values: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values that start at each position; shorter at the
    end, so ``len(h) - size + 1`` values (at least 0)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(out)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(store: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``store[first:first + count]`` one after the other, and their ends."""
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    take = np.arange(ends[-1]) + np.repeat(first - ends[:-1], count)
    return store[take], ends


EACH = 120  # bytes that a stored word takes beside its characters


class WordIds:
    """Ids of the words that a worker has met, kept up to about ``limit`` bytes
    (``EACH`` and its length for a word); beyond that the store starts anew. ``encode`` gives the ids of a
    list of words and the word boundaries in them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 48 << 20):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size = 0
        self.ids, self.ends = np.empty(0, np.int64), np.zeros(1, np.int64)

    def look_up(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The store of ids, and where those of each (distinct) word begin and
        how many they are."""
        fresh = [w for w in values if w not in self.place]
        if self.size + EACH * len(fresh) + sum(map(len, fresh)) > self.limit:
            self._forget()
            fresh = values
        if fresh:
            ids, bounds = self.encode(fresh)
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.size += EACH * len(fresh) + sum(map(len, fresh))
            self.ends = np.concatenate([self.ends, self.ends[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, ids])
        at = np.fromiter((self.place[w] for w in values), np.int64, len(values))
        return self.ids, self.ends[at], self.ends[at + 1] - self.ends[at]
