"""Encoding with the installed tokenizer library, once per distinct chunk.

A chunk is a run of white space with the text up to the next one or to a mark
after a letter. With the pre-token patterns named below a pre-token never
crosses these places, so the tokens of a text are those of its chunks in a row;
only boundaries that are certain from the bytes are cut, others stay inside a
chunk. Texts of other tokenizers are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from timberflow.llm.texts import raw_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: After these bytes no cut is made: control characters, and lead bytes of
#: characters of which some are white space.
_UNSURE = np.zeros(256, bool)
_UNSURE[:33] = True
_UNSURE[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?#$%&*()'\"")] = True
KNOWN_CHUNKS = 1 << 20
CALL = 10_000  # texts handed to the library at once

# Fixed value: the word pattern of one public tokenizer file.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def digest_of(path: str) -> str:
    """Digest of a tokenizer file: its version in caches and file headers."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all rows, and the index of each row's first chunk."""
    body, bounds = raw_bytes(texts)
    cut = np.zeros(len(body) + 1, bool)
    if len(body):
        left, right = body[:-1], body[1:]
        at = np.flatnonzero(_SPACE[right] & ~_UNSURE[left] | _MARK[right] & _LETTER[left]) + 1
        wide = body[at - 1] >= 128
        two, three = body[np.maximum(at - 2, 0)], body[np.maximum(at - 3, 0)]
        cut[at[~(wide & (_UNSURE[two] & (two >= 128) | _UNSURE[three] & (three >= 128)))]] = True
    cut[bounds] = True
    starts = np.flatnonzero(cut)
    parts = pa.StringArray.from_buffers(
        len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(body)
    )
    return parts, np.searchsorted(starts, bounds)


def cuts_safely(tokenizer: dict) -> bool:
    """Whether chunks may be encoded apart: the pre-tokenizer has one of the
    two known patterns, and no added token contains a place that is cut or
    takes in the white space around it."""
    split = tokenizer.get("pre_tokenizer") or {}
    steps = split.get("pretokenizers", [split])
    known = [
        s.get("type") == "ByteLevel" and not s.get("add_prefix_space") or s.get("pattern", {}).get("Regex") == _WORD_PATTERN
        for s in steps
    ]
    splits = any(s.get("use_regex") or s.get("type") == "Split" for s in steps)
    added = [t for t in tokenizer.get("added_tokens", []) if not (t["lstrip"] or t["rstrip"] or t["single_word"])]
    whole = all(len(chunks(pa.array([t["content"]]))[0]) == 1 for t in added)
    return all(known) and splits and whole and len(added) == len(tokenizer.get("added_tokens", []))


class ChunkEncoder:
    """Token ids of whole texts. Chunks already met by this worker are kept up
    to ``KNOWN_CHUNKS`` and looked up; beyond that the store starts anew."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.whole = None, True
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.whole = not cuts_safely(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ends = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _library(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = []
        for at in range(0, len(values), CALL):
            part = values[at : at + CALL]
            if self.model is not None:
                found += self.model.encode(part, num_threads=1)
            else:
                found += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        return sizes, flat

    def _encode(self, values: pa.Array) -> np.ndarray:
        """Index of each distinct value in the store."""
        if len(self.known) + len(values) > KNOWN_CHUNKS:
            self._forget()
        place = pc.index_in(values, value_set=self.known)
        fresh = values.filter(pc.is_null(place))
        if len(fresh):
            sizes, flat = self._library(fresh.to_pylist())
            self.ids = np.concatenate([self.ids, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.known = pa.concat_arrays([self.known, fresh])
            place = pc.index_in(values, value_set=self.known)
        return place.to_numpy().astype(np.int64)

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.whole:
            parts, rows = texts, np.arange(len(texts) + 1)
        else:
            parts, rows = chunks(texts)
        coded = parts.dictionary_encode()
        return self._encode(coded.dictionary)[coded.indices.to_numpy()], rows

    def counts(self, texts: pa.Array) -> np.ndarray:
        place, rows = self._parts(texts)
        sizes = np.concatenate([[0], np.cumsum(self.ends[place + 1] - self.ends[place])])
        return np.diff(sizes[rows])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the row boundaries in them."""
        place, rows = self._parts(texts)
        first, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], sizes)
        return self.ids[take], bounds[rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file."""
    return ChunkEncoder(path)
