"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Texts are cut where no piece of the vocabulary can cross; the distinct parts
("words") of a batch stand in one flat array of symbols. Each round finds the
best rank among the adjacent pairs of every word (a segmented minimum), merges
the leftmost pairs of that rank in all words at once, and compacts the arrays;
words without a mergeable pair leave them. A piece that could join an earlier
merge once it exists is merged at one place per word and round, so the order is
that of one merge after the other.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from timberflow.llm.texts import WordIds, plain, raw_bytes, slices, spread

SLICE = 4 << 20
LONG_WORD = 4096  # symbols from which a word is merged with a heap of its own
NEVER = np.iinfo(np.int32).max

# Fixed values of the public model format: kinds of pieces, the blank's stand-in.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BLANK = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at : at + size]
        at += size


class MergeRounds:
    """Pieces and merge order of a SentencePiece BPE model with byte pieces, no
    own normalisation and a blank put before each text."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        # fields of the format: 1 pieces (1 text, 2 score, 3 kind), 2 trainer
        # (3 model type, 35 byte fallback), 3 normaliser (2 character map,
        # 3 blank before the text, 4 blanks removed, 5 blanks replaced)
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        trainer, normal = ({f: v for key, part in model if key == k for f, v in _fields(part)} for k in (2, 3))
        kinds = np.array([p.get(3, NORMAL) for p in pieces])
        if (
            trainer.get(3) != 2 or not trainer.get(35) or set(kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}
            or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1)
        ):
            raise ValueError(f"{path} is not a plain BPE model with byte pieces")
        names = [p[1].decode().replace(BLANK, " ") for p in pieces]
        score = {names[i]: struct.unpack("<f", pieces[i].get(2, b"\0" * 4))[0] for i in np.flatnonzero(kinds == NORMAL)}
        number = {names[i]: int(i) for i in np.flatnonzero(kinds == NORMAL)}
        self.bytes_at = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.bytes_at[int(names[i][1:-1], 16)] = i
        self._symbols(names, number)
        self._pairs(score)
        surface = [
            bytes([int(n[1:-1], 16)]) if k == BYTE else {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(k, n.encode())
            for n, k in zip(names, kinds.tolist(), strict=True)
        ]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface])
        self.surface_first = np.cumsum(self.surface_size) - self.surface_size
        self.kinds, self.opens = kinds, np.array([n.startswith(" ") for n in names]) & (kinds == NORMAL)
        self.known = WordIds(self.encode_words)

    def _symbols(self, names: list[str], number: dict[str, int]) -> None:
        """Characters and pieces as symbols, and the pairs of neighbouring
        characters that some piece holds."""
        self.symbol: dict[str, int] = {}
        crosses = np.zeros((129, 129), bool)  # 128: any other character
        crosses[128, 128] = True
        for name in number:
            self.symbol.setdefault(name, len(self.symbol))
            for c in name:
                self.symbol.setdefault(c, len(self.symbol))
            classes = [min(ord(c), 128) for c in name]
            for a, b in zip(classes, classes[1:], strict=False):
                crosses[a, b] = True
        self.crosses = crosses
        self.of_char = np.full(0x110000, -1, np.int64)
        for name, s in self.symbol.items():
            if len(name) == 1:
                self.of_char[ord(name)] = s
        self.piece = np.array([number.get(name, -1) for name in self.symbol], np.int64)
        self.char = np.array([ord(name) if len(name) == 1 else 0 for name in self.symbol], np.int64)

    def _pairs(self, score: dict[str, float]) -> None:
        """For every pair of symbols that makes a piece: its rank (equal scores
        share one) and the symbol made."""
        level = {s: r for r, s in enumerate(sorted({s for n, s in score.items() if len(n) > 1}, reverse=True))}
        size = np.zeros(len(level), np.int64)
        found, once = {}, np.zeros(len(level) + 1, bool)
        for name, s in score.items():
            if len(name) > 1:
                size[level[s]] += 1
            for cut in range(1, len(name)):
                left, right = self.symbol.get(name[:cut]), self.symbol.get(name[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = (level[s], self.symbol[name])
                    for part in (name[:cut], name[cut:]):
                        if len(part) > 1 and score[part] <= s:
                            once[level[score[part]]] = True
        once[:-1] |= size > 1
        keys = np.array(sorted(found), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([found[k][0] for k in keys.tolist()] + [NEVER], np.int32)
        self.made = np.array([found[k][1] for k in keys.tolist()] + [0], np.int64)
        self.pair, self.once = found, once

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all rows that no merge can leave, and the index of each
        row's first part. Every text that is not empty gets its blank."""
        texts = pc.replace_substring(texts, BLANK, " ")
        blank = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        body, bounds = raw_bytes(pc.binary_join_element_wise(blank, texts, ""))
        cut = np.zeros(len(body) + 1, bool)
        if len(body):
            kind = np.minimum(body, 128)
            cut[1:-1] = ~self.crosses[kind[:-1], kind[1:]]
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        parts = pa.StringArray.from_buffers(
            len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(body)
        )
        return parts, np.searchsorted(starts, bounds)

    def _one_by_one(self, sym: list[int]) -> list[int]:
        """Merges of a single long word from a heap of its pairs."""
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def meet(a: int, b: int) -> None:
            if a >= 0 and b < n:
                known = self.pair.get(sym[a] << 32 | sym[b]) if sym[a] >= 0 and sym[b] >= 0 else None
                if known:
                    heapq.heappush(heap, (known[0], a, sym[a], sym[b]))

        for k in range(n - 1):
            meet(k, k + 1)
        gone = -1 << 62
        while heap:
            _, a, x, y = heapq.heappop(heap)
            b = right[a]
            if sym[a] != x or b >= n or sym[b] != y:
                continue
            sym[a], sym[b] = self.pair[x << 32 | y][1], gone
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            meet(left[a], a)
            meet(a, right[a])
        return [s for s in sym if s != gone]

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left when no pair remains, with their words."""
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, key)
            rank = np.full(len(sym), NEVER, np.int32)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], NEVER)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = best != NEVER
            ready.append((sym[~live], word[~live]))
            pos = np.flatnonzero(live & (rank == best))
            first = np.flatnonzero(np.diff(pos, prepend=-2) != 1)  # runs of overlapping pairs: every other one
            keep = (pos - np.repeat(pos[first], np.diff(np.append(first, len(pos))))) % 2 == 0
            keep &= ~self.once[rank[pos]] | (np.diff(word[pos], prepend=-1) != 0)
            pos = pos[keep]
            sym[pos] = self.made[at[pos]]
            live[pos + 1] = False
            sym, word = sym[live], word[live]
        done = [np.concatenate(part) if part else np.empty(0, np.int64) for part in zip(*ready, strict=True)] or [sym, word]
        order = np.argsort(done[1], kind="stable")
        return done[0][order], done[1][order]

    def encode_words(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the word boundaries in them."""
        chars = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        word = np.repeat(np.arange(len(values)), sizes)
        sym = self.of_char[chars]
        sym = np.where(sym < 0, -1 - chars, sym)  # characters of no piece
        long = np.flatnonzero(sizes > LONG_WORD)
        alone = np.isin(word, long) if len(long) else np.zeros(len(word), bool)
        left, owner = self._merge(sym[~alone], word[~alone])
        for k in long.tolist():
            own = np.array(self._one_by_one(sym[word == k].tolist()), np.int64)
            left, owner = np.concatenate([left, own]), np.concatenate([owner, np.full(len(own), k)])
        if len(long):
            order = np.argsort(owner, kind="stable")
            left, owner = left[order], owner[order]
        piece = np.where(left >= 0, self.piece[left], -1)
        raw = piece < 0
        char = np.where(left >= 0, self.char[left], -1 - left)[raw]
        body = "".join(map(chr, char.tolist())).encode()
        store = np.concatenate([piece, self.bytes_at[np.frombuffer(body, np.uint8)]])
        count = np.ones(len(piece), np.int64)
        count[raw] = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        first = np.arange(len(piece))
        first[raw] = len(piece) + np.cumsum(count[raw]) - count[raw]
        ids, ends = spread(store, first, count)
        return ids, ends[np.searchsorted(owner, np.arange(len(values) + 1))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the row boundaries in them."""
        parts, rows = self.words(texts)
        coded = parts.dictionary_encode()
        store, first, count = self.known.look_up(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        ids, ends = spread(store, first[codes], count[codes])
        return ids, ends[rows]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of id rows, without the blank before a text; a byte that is no
        UTF-8 becomes the replacement character."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.kinds)):
            raise ValueError("an id is not in the vocabulary")
        size = self.surface_size[ids].copy()
        first = self.surface_first[ids].copy()
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        head = np.searchsorted(shown, bounds[:-1])  # the first shown id of each row, if it has one
        has = head < np.searchsorted(shown, bounds[1:])
        head = shown[head[has]]
        head = head[self.opens[ids[head]]]
        first[head] += 1
        size[head] -= 1
        body, ends = spread(self.surface, first, size)
        data = [pa.py_buffer(x) for x in (ends[bounds].astype(np.int32).tobytes(), body.tobytes())]
        texts = pa.StringArray.from_buffers(len(bounds) - 1, *data)
        broken = len(shown) < len(ids)  # bytes on both sides of a control id are not one character
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            broken = True
        if not broken:
            return texts
        control = np.flatnonzero(self.kinds[ids] == CONTROL)
        cuts = np.split(control, np.searchsorted(control, bounds[1:-1]))
        runs = zip(bounds[:-1].tolist(), bounds[1:].tolist(), cuts if len(bounds) > 1 else [], strict=True)
        edges = ([a, *c.tolist(), b] for a, b, c in runs)
        whole = body.tobytes()
        return pa.array(
            ["".join(_lenient(whole[ends[x] : ends[y]]) for x, y in zip(e, e[1:], strict=False)) for e in edges], pa.string()
        )


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def merge_rounds(path: str) -> MergeRounds:
    return MergeRounds(path)


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ids array<int> and, if asked for, the
    decoded text. A null or empty text gives no ids and an empty text; null
    ids, ties and repeated rows keep a row each; other columns, of whatever
    name, are not read. Texts are taken whole, a long one in a batch of its
    own. Nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        model = merge_rounds(model_path)
        for part in slices(batches, "__text", SLICE):
            ids, bounds = model.encode(plain(part.column("__text")))
            out = [part.column("__id"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))]
            if decoded:
                out.append(model.decode(ids, bounds))
            yield pa.RecordBatch.from_arrays(out, ["__id", "ids", "decoded"][: len(out)])

    schema = f"__id {kind}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text, an id
    outside the vocabulary is an error. A column ``out_col`` is replaced."""

    def run(batches):
        model = merge_rounds(model_path)
        for batch in batches:
            lists = pc.fill_null(batch.column(ids_col), [])
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = model.decode(flat.astype(np.int64), (bounds - bounds[0]).astype(np.int64))
            kept = {n: batch.column(n) for n in batch.schema.names if n != out_col}
            yield pa.RecordBatch.from_pydict(kept | {out_col: texts})

    fields = [f for f in rows.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.select([F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, f"{schema}, `{out_col}` string")
