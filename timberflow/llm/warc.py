"""WARC archives of dictionary-compressed records.

A file starts with a skippable Zstandard frame that holds the dictionary; every
record then is a frame of its own. Records with the payload of another one are
revisits that name it and carry no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from timberflow.llm.files import put
from timberflow.llm.texts import slices
from timberflow.session import stored

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D.to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"

DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 16 << 20
#: A file ends with the record that brings it to so many bytes before compression.
FILE_BYTES = 256 << 20
LEVEL = 3
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page, so that a repeated task writes the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None, revisit: bool) -> bytes:
    block = HTTP if revisit else HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, payload_col: str = "html", id_col: str = "page_id", size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most ``SAMPLE_ROWS`` records and ``SAMPLE_BYTES``
    bytes, picked by a hash of the id; empty where they are too few to train."""
    picked = pages.select(F.col(id_col).alias("id"), F.octet_length(payload_col).alias("n")).orderBy(F.xxhash64("id"), "id")
    room, ids = SAMPLE_BYTES, []
    for row in picked.limit(SAMPLE_ROWS).collect():
        if row["id"] is not None and row["n"] and row["n"] <= room:
            room -= row["n"]
            ids.append((row["id"],))
    if len(ids) < 8:
        return b""
    chosen = pages.sparkSession.createDataFrame(ids, "id bigint").distinct()
    texts = pages.select(F.col(id_col).alias("id"), F.col(payload_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = texts.groupBy("id").agg(F.max("text").alias("text")).orderBy("id").collect()
    try:
        return zstandard.train_dictionary(size, [HTTP + r["text"].encode() for r in rows], level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too small or too few
        return b""


def file_parts(dictionary: bytes, records: Iterator[bytes]) -> Iterator[bytes]:
    if dictionary:
        yield SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
    for data in records:
        yield compressor.compress(data)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one frame at a time."""
    at, known = 0, None
    if content[:4] == SKIPPABLE:
        at = 8 + int.from_bytes(content[4:8], "little")
        known = zstandard.ZstdCompressionDict(content[8:at])
    view = memoryview(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while at < len(content):
        frame = decompressor.decompressobj()
        data, step = [], 1 << 16
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the file ends inside a record")
            piece = view[at : at + step]
            data.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        head, _, rest = b"".join(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    smallest: int = 0,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record per row of ``pages``, a file or more per partition of page
    ids, each ending with the record that brings it to ``file_bytes`` before
    compression; returns the manifest (file, n_records, n_bytes), a row per file.

    Of records with equal payloads of at least ``smallest`` bytes the one with
    the largest id is the response, the others refer to it; smaller ones are
    all responses. A null payload counts as empty. Rows that repeat an id with
    an equal payload are all responses if the id is the largest; null ids come
    below all others, and payloads that only rows with null ids have are all
    responses. An empty table gives no file.

    Copies are found by digest alone: a group of any size is reduced before
    the shuffle, and payloads move once, by id.
    """
    spark = pages.sparkSession
    dictionary = train_dictionary(pages, payload_col, id_col)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    sha = F.sha1(F.col("payload").cast("binary"))
    keys = rows.select("page_id", sha.alias("sha"), F.octet_length("payload").alias("n"))
    last = keys.filter(F.col("n") >= smallest).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1 AND last IS NOT NULL")
    copies = keys.join(last.select("sha", "last"), "sha").filter("NOT (page_id <=> last)")
    copies = stored(copies.select(F.col("page_id").alias("id"), F.col("sha").alias("own"), "last").distinct(), "warc-copies")
    joined = rows.withColumn("sha", sha).join(copies, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own")), "left")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = joined.select("page_id", "url", "payload", "last").repartitionByRange(count, "page_id", F.xxhash64("payload"))
    dealt = dealt.sortWithinPartitions("page_id", F.xxhash64("payload"), "url")

    def write(batches):
        number, roll = TaskContext.get().partitionId(), 0

        def records():
            for part in slices(batches, "payload"):
                for row in part.to_pylist():
                    payload = row["payload"].encode()
                    yield record(row["page_id"], row["url"], payload, payload_digest(payload), date, row["last"], row["last"] is not None)

        waiting = records()
        upcoming = next(waiting, None)
        count = 0

        def of_file():
            nonlocal upcoming, count
            held = count = 0
            while upcoming is not None and held < file_bytes:
                data = upcoming
                held += len(data)
                count += 1
                yield data
                upcoming = next(waiting, None)

        while upcoming is not None:
            name = f"pages-{number:08d}-{roll:06d}{SUFFIX}"
            size = put(folder, name, file_parts(dictionary, of_file()))
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [count], "n_bytes": [size]})
            roll += 1

    return stored(dealt.mapInArrow(write, "file string, n_records bigint, n_bytes bigint"), "warc-manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in a folder: page_id, url, payload_bytes,
    payload_digest (bare base32), record_type, refers_to and, if asked for,
    the payload (null for revisits). Payloads are checked against their
    digests; a mismatch raises."""

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in read_records(content.as_py()):
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                    if payload is not None and payload_digest(payload) != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                    number = fields.get("WARC-Page-ID")
                    other = fields.get("WARC-Refers-To-Page-ID")
                    row = [
                        number and int(number), fields.get("WARC-Target-URI"), int(fields["WARC-Payload-Length"]),
                        digest, fields["WARC-Type"], other and int(other),
                    ]
                    rows.append(row + [payload] * payloads)
                    if len(rows) == 4096 or payload and payloads and len(payload) > 1 << 20:
                        yield _batch(rows, payloads)
                        rows = []
                yield _batch(rows, payloads)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")
    return files.mapInArrow(read, SCHEMA + ", payload binary" * payloads)


def _batch(rows: list, payloads: bool) -> pa.RecordBatch:
    names = [field.split(" ")[0] for field in SCHEMA.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
