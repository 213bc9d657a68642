"""Token ids in files of Simple-8b blocks.

Layout of a file (little endian): 8 bytes magic; length of the JSON header (u64)
and the header; blocks of words, each of up to ``BLOCK`` ids; the block table
(byte offset u64, ids before it u64); the document table (doc id i64, its first
id u64, 1 for a null id u8); number of blocks, documents and ids (u64 each),
offset of the block table (u64) and the magic again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from timberflow.llm.chunks import digest_of, encoder
from timberflow.llm.files import put
from timberflow.llm.simple8b import pack, unpack
from timberflow.llm.texts import plain, slices
from timberflow.session import stored

MAGIC = b"S8TOKEN1"
BLOCK = 1 << 16
SUFFIX = ".s8tok"
#: A file ends with the slice of texts that brings it to so many ids (about 64
#: MB of words); a reader holds one file at a time.
FILE_IDS = 1 << 25


def file_parts(rows: Iterator[tuple[pa.Array, np.ndarray, np.ndarray]], header: dict, total: list[int]) -> Iterator[bytes]:
    """Bytes of one file. ``rows`` gives doc ids, token ids and row boundaries
    batch by batch; ``total`` gets the number of ids and documents."""
    head = json.dumps(header, sort_keys=True).encode()
    head += b" " * (-len(head) % 8)
    yield MAGIC + len(head).to_bytes(8, "little") + head
    offset, before, rest = 16 + len(head), 0, np.empty(0, np.uint32)
    offsets, firsts, docs, starts, nulls = [], [], [], [], []

    def block(ids: np.ndarray) -> bytes:
        nonlocal offset, before
        offsets.append(offset)
        firsts.append(before)
        data = pack(ids).astype("<u8").tobytes()
        offset += len(data)
        before += len(ids)
        return data

    for doc_ids, ids, bounds in rows:
        starts.append(bounds[:-1].astype(np.int64) + before + len(rest))
        nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        rest = np.concatenate([rest, ids])
        while len(rest) >= BLOCK:
            yield block(rest[:BLOCK])
            rest = rest[BLOCK:]
    if len(rest):
        yield block(rest)
    yield np.array([offsets, firsts], "<u8").tobytes()
    n_docs = sum(map(len, docs))
    for part, kind in ((docs, "<i8"), (starts, "<u8"), (nulls, "u1")):
        yield np.concatenate([np.empty(0), *part]).astype(kind).tobytes() if not part else np.concatenate(part).astype(kind).tobytes()
    yield np.array([len(offsets), n_docs, before, offset], "<u8").tobytes() + MAGIC
    total[:] = [before, n_docs]


class TokenFile:
    """A file's content, decoded block by block."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        self.content = content
        self.header = json.loads(content[16 : 16 + int.from_bytes(content[8:16], "little")])
        blocks, docs, self.n_ids, at = np.frombuffer(content, "<u8", 4, len(content) - 40).tolist()
        self.offsets, self.firsts = np.frombuffer(content, "<u8", 2 * blocks, at).reshape(2, blocks).astype(np.int64)
        self.offsets = np.append(self.offsets, at)
        self.firsts = np.append(self.firsts, self.n_ids)
        at += 16 * blocks
        self.doc_ids = np.frombuffer(content, "<i8", docs, at)
        self.starts = np.append(np.frombuffer(content, "<u8", docs, at + 8 * docs).astype(np.int64), self.n_ids)
        self.nulls = np.frombuffer(content, "u1", docs, at + 16 * docs).astype(bool)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from ``first`` up to ``last``; reads only their blocks."""
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(self.firsts, first, side="right") - 1, np.searchsorted(self.firsts, last)
        parts = [
            unpack(
                np.frombuffer(self.content, "<u8", (self.offsets[k + 1] - self.offsets[k]) // 8, self.offsets[k]),
                self.firsts[k + 1] - self.firsts[k],
            )
            for k in range(a, b)
        ]
        return np.concatenate(parts)[first - self.firsts[a] : last - self.firsts[a]].astype(np.uint32)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id``, and write ids in ascending
    ``id_col`` order, one file or more per range of ids, each of ``file_ids`` ids
    and one slice of texts at most. Returns the manifest, one row per file: file
    (name; names ascend with the ids), file_no (of the range), n_tokens, n_docs.

    Null ids come first; equal ids are ordered by a hash of their texts, then
    by the texts, so the files are the same each time. Null texts count as
    empty and give the end id alone. An empty table gives no file. Texts move
    once, by range of (id, hash), which also splits the rows of a repeated id.
    """
    spark = docs.sparkSession
    version = digest_of(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__h"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(count, "__id", "__h").sortWithinPartitions("__id", "__h", "__text")

    def write(batches):
        number, roll = TaskContext.get().partitionId(), 0
        parts = iter(slices(batches, "__text"))
        part = next(parts, None)

        def encoded():
            """Slices up to the end of a file."""
            nonlocal part
            held = 0
            while part is not None and held < file_ids:
                ids, bounds = encoder(tokenizer_path).encode(plain(part.column("__text")))
                yield part.column("__id"), np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                held += int(bounds[-1]) + len(bounds) - 1
                part = next(parts, None)

        while part is not None:
            total = [0, 0]
            name = f"part-{number:08d}-{roll:06d}{SUFFIX}"
            put(folder, name, file_parts(encoded(), {"tokenizer": version, "end_id": end_id, "block": BLOCK}, total))
            yield pa.RecordBatch.from_pydict(
                {"file": pa.array([name]), "file_no": pa.array([number], pa.int64())}
                | {k: pa.array([v], pa.int64()) for k, v in zip(("n_tokens", "n_docs"), total, strict=True)}
            )
            roll += 1

    schema = "file string, file_no bigint, n_tokens bigint, n_docs bigint"
    return stored(ordered.select("__id", "__text").mapInArrow(write, schema), "token-manifest")


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of the files: ``id_col``, start (ids of all documents
    before it), ids (little-endian unsigned 32-bit, binary)."""
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{id_col} bigint, start bigint, ids binary")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{SUFFIX}")
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    )

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                file = TokenFile(content.as_py())
                at = 0
                while at < len(file.doc_ids):
                    end = max(at + 1, int(np.searchsorted(file.starts, file.starts[at] + 16 * BLOCK, side="right")) - 1)
                    end = min(end, len(file.doc_ids))
                    bounds = file.starts[at : end + 1]
                    data = file.ids(int(bounds[0]), int(bounds[-1])).astype("<u4").tobytes()
                    sizes = ((bounds - bounds[0]) * 4).astype(np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": pa.array([name.as_py()] * (end - at)),
                            id_col: pa.array(file.doc_ids[at:end], mask=file.nulls[at:end]),
                            "place": pa.array(bounds[:-1]),
                            "ids": pa.BinaryArray.from_buffers(
                                pa.binary(), end - at, [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(data)]
                            ),
                        }
                    )
                    at = end

    rows = files.mapInArrow(read, f"file string, {id_col} bigint, place bigint, ids binary")
    # one row per file: a running sum over them is small
    before = F.sum("n_tokens").over(W.orderBy("file")) - F.col("n_tokens")
    starts = manifest.select("file", before.alias("before"))
    return rows.join(starts, "file").select(id_col, (F.col("before") + F.col("place")).alias("start"), "ids")
