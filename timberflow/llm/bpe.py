"""Byte-pair encoding and decoding with a pair occurrence index.

A batch of texts is cut to its distinct words. All their symbols stand in one
array with links to the neighbours; the index maps the rank of every mergeable
pair to all positions where the pair starts. Words met before in the partition
are looked up. Ranks are taken in ascending order
from a heap; all occurrences of the pair are merged at once, from left to
right, and the pairs that arise next to them enter the lists of their ranks.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from timberflow.llm.chunks import chunks, cuts_safely
from timberflow.llm.texts import WordIds, plain, slices, spread


SLICE = 2 << 20  # bytes of text in a batch; its new words share one index


class PairIndexBpe:
    """Vocabulary and merges of a tokenizer file with an optional end-of-word
    suffix and no continuation prefix, unknown token or byte fallback."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.parts = Tokenizer.from_file(path)  # its normaliser and word splitter only
        spec = json.loads(self.parts.to_str())
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("decoder") is not None:
            raise ValueError(f"{path} is not a plain BPE tokenizer without decoder: {odd}")
        self.whole = not cuts_safely(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names: list[str | None] = [None] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for name, i in [*self.vocab.items(), *self.added.items()]:
            names[i] = name
        # each name with a blank behind it, then each without, as a row ends
        self.names, self.last = pa.array(["" if n is None else f"{n} " for n in names] + [n or "" for n in names]), len(names)
        self.known = WordIds(self._encode_chunks)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            first.setdefault(self.vocab[a] << 32 | self.vocab[b], (rank, self.vocab[a + b]))
        keys = np.array(sorted(first), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.ranks = np.array([first[k][0] for k in keys.tolist()] + [-1], np.int64)
        self.made = np.zeros(len(pairs) + 1, np.int64)
        for rank, new in first.values():
            self.made[rank] = new

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (already in the alphabet of the vocabulary), and
        the word boundaries in them."""
        vocab, suffix = self.vocab, self.suffix
        symbols, sizes = [], np.zeros(len(values), np.int64)
        for k, word in enumerate(values):
            found = [vocab[c] for c in word[:-1] if c in vocab]
            if word and word[-1] + suffix in vocab:
                found.append(vocab[word[-1] + suffix])
            symbols += found
            sizes[k] = len(found)
        sym = np.array(symbols, np.int64)
        n, ends = len(sym), np.cumsum(sizes)
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends[sizes > 0] - 1] = n  # the end of a word has no neighbour
        left[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n + 1, bool)
        sym = np.append(sym, 0)
        index: dict[int, list[int]] = {}
        at = np.flatnonzero(right < n)
        rank = self._rank(sym[at], sym[right[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        for part, r in zip(np.split(at, cuts[1:]), rank[cuts].tolist(), strict=True) if len(at) else ():
            index[r] = part.tolist()
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            pos = np.array(index.pop(r), np.int64)
            pos.sort()
            pos = pos[alive[pos] & (right[pos] < n)]
            pos = pos[self._rank(sym[pos], sym[right[pos]]) == r]  # lists may hold pairs that have changed
            if len(pos) > 1 and (np.diff(pos) == 0).any():
                pos = np.unique(pos)
            nxt = right[pos]
            if len(pos) > 1 and (nxt[:-1] == pos[1:]).any():  # a run of equal symbols: every other pair
                keep, last = [], -1
                for p, q in zip(pos.tolist(), nxt.tolist(), strict=True):
                    if p != last:
                        keep.append(p)
                        last = q
                pos = np.array(keep, np.int64)
                nxt = right[pos]
            sym[pos] = self.made[r]
            alive[nxt] = False
            after = right[nxt]
            right[pos] = after
            inner = after < n
            left[after[inner]] = pos[inner]
            before = left[pos]
            starts = np.concatenate([before[before >= 0], pos[inner]])
            rank = self._rank(sym[starts], sym[right[starts]])
            for q, p in zip(rank.tolist(), starts.tolist(), strict=True):
                if q >= 0:
                    if q in index:
                        index[q].append(p)
                    else:
                        index[q] = [p]
                        heapq.heappush(heap, q)
        live = alive[:n]
        before = np.zeros(n + 1, np.int64)
        np.cumsum(live, out=before[1:])
        return sym[:n][live], np.concatenate([[0], before[ends]])

    def _split(self, text: str) -> list[int | str]:
        """Words of a text after normalisation; ids of added tokens."""
        pieces: list[int | str] = [text]
        for name, i in self.added.items():
            if name in text:
                pieces = [
                    x
                    for p in pieces
                    for x in ([p] if isinstance(p, int) else [y for q in p.split(name) for y in (q, i)][:-1])
                ]
        out: list[int | str] = []
        for p in pieces:
            if isinstance(p, int):
                out.append(p)
            elif p:
                normal = self.parts.normalizer.normalize_str(p) if self.parts.normalizer else p
                out += [w for w, _ in self.parts.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the row boundaries in them."""
        parts, rows = (texts, np.arange(len(texts) + 1)) if self.whole else chunks(texts)
        coded = parts.dictionary_encode()
        store, first, count = self.known.look_up(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        ids, ends = spread(store, first[codes], count[codes])
        return ids, ends[rows]

    def _encode_chunks(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and the chunk boundaries in them."""
        number: dict[str, int] = {}
        flat, sizes = [], np.zeros(len(values), np.int64)
        for k, chunk in enumerate(values):
            found = [-1 - w if isinstance(w, int) else number.setdefault(w, len(number)) for w in self._split(chunk)]
            flat += found
            sizes[k] = len(found)
        ids, bounds = self.encode_words(list(number))
        pieces = np.array(flat, np.int64)
        special = pieces < 0
        # added tokens follow the words in one store
        store = np.concatenate([ids, -1 - pieces[special]])
        first, count = bounds[np.where(special, 0, pieces)], np.ones(len(pieces), np.int64)
        first[special] = len(ids) + np.arange(special.sum())
        count[~special] = np.diff(bounds)[pieces[~special]]
        ids, ends = spread(store, first, count)
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of id rows: without a decoder, names joined by blanks."""
        ends = bounds[1:][np.diff(bounds) > 0] - 1
        of = ids.astype(np.int32)
        of[ends] += self.last  # no blank after the last name
        pieces = self.names.take(pa.array(of))
        _, offsets, body = pieces.buffers()
        starts = np.frombuffer(offsets, np.int32)[: len(of) + 1] if len(of) else np.zeros(1, np.int32)
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(starts[bounds].tobytes()), body or pa.py_buffer(b""))


@lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode_texts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ids array<int> and, if asked for, the
    decoded text. A null or empty text gives no ids and an empty text; null
    ids, ties and repeated rows keep a row each; other columns are not read.
    Nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches):
        model = pair_index(tokenizer_path)
        for part in slices(batches, "__text", SLICE):
            ids, bounds = model.encode(plain(part.column("__text")))
            out = [part.column("__id"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids.astype(np.int32))]
            if decoded:
                out.append(model.decode(ids, bounds))
            yield pa.RecordBatch.from_arrays(out, ["__id", "ids", "decoded"][: len(out)])

    schema = f"__id {kind}, ids array<int>" + ", decoded string" * decoded
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def decode_ids(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text."""

    def run(batches):
        model = pair_index(tokenizer_path)
        for batch in batches:
            lists = pc.fill_null(batch.column(ids_col), [])
            flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = model.decode(flat.astype(np.int64), (bounds - bounds[0]).astype(np.int64))
            kept = {n: batch.column(n) for n in batch.schema.names if n != out_col}
            yield pa.RecordBatch.from_pydict(kept | {out_col: texts})

    fields = [f for f in rows.schema.fields if f.name != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.select([F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, f"{schema}, `{out_col}` string")
