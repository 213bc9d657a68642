"""Bounded samples of labelled rows, and hashed terms of words."""

from __future__ import annotations

import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timberflow.llm.texts import hashes, mix, raw_bytes, windows
from timberflow.session import stored

SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 7 << 20


class Sample(NamedTuple):
    texts: pa.Array
    labels: np.ndarray  # 0 or 1
    weights: np.ndarray  # restores the share of each label among all labelled rows
    folds: np.ndarray  # 0 to 4, from a hash of the id


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    where: Column | None = None,
    rows: int = SAMPLE_ROWS,
    size: int = SAMPLE_BYTES,
) -> Sample:
    """At most ``rows`` labelled rows of ``docs``, half of each label at most,
    and at most ``size`` bytes of whole texts, picked by a hash of the id.
    Labels of other documents do not count. Rows with a null id or label are
    left out; a repeated id counts once, with its largest label. A label that
    no row has is reported as a warning; the sample may be empty. Both bounds
    hold for what reaches the driver and what is broadcast to find it."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("label"))
    known = stored(known.join(docs.select(F.col(id_col).alias("__id")), "__id", "left_semi"), "labelled")
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = [known.filter(F.col("label") == k).orderBy(*order).limit(rows // 2) for k in (0, 1)]
    ids = picked[0].unionAll(picked[1])
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "__id").groupBy("__id", "label")
    sizes = found.agg(F.max(F.octet_length("text")).alias("n")).orderBy(*order).limit(rows).collect()
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(total) < 2:
        warnings.warn(f"labelled documents have {label_col} {sorted(total)} only; nothing tells 0 from 1", stacklevel=2)
    room, chosen = size, []
    for row in sizes:
        if row["n"] <= room:
            room -= row["n"]
            chosen.append(row)
    if not chosen:
        empty = np.empty(0)
        return Sample(pa.array([], pa.string()), empty, empty, empty)
    keep = docs.sparkSession.createDataFrame([(r["__id"],) for r in chosen], "__id bigint")
    table = (
        texts.join(F.broadcast(keep.join(F.broadcast(ids), "__id")), "__id")
        .groupBy("__id", "label")
        .agg(F.max("text").alias("text"), (F.max(F.xxhash64("__id")) % 5).alias("fold"))
        .toArrow()
        .sort_by("__id")
    )
    y = table["label"].to_numpy()
    share = {k: total[k] / sum(total.values()) * len(y) / max(1, (y == k).sum()) for k in total}
    return Sample(
        pa.concat_arrays(table["text"].chunks), y, np.array([share[k] for k in y.tolist()]), np.abs(table["fold"].to_numpy())
    )


class Terms(NamedTuple):
    """Hashed terms of the words of a vocabulary: ``buckets[j]`` belongs to
    word ``owner[j]``, owners ascending."""

    owner: np.ndarray
    buckets: np.ndarray


def word_terms(vocab: pa.Array, bits: int, sizes: tuple[int, ...]) -> list[Terms]:
    """The word itself, and all its n-grams of the given numbers of bytes with
    a mark before the first and after the last byte."""
    shift, n = np.uint64(64 - bits), len(vocab)
    out = [Terms(np.arange(n, dtype=np.int32), (mix(hashes(vocab)) >> shift).astype(np.int32))]
    body, bounds = raw_bytes(vocab)
    ends = bounds[1:] + 2 * np.arange(1, n + 1)
    padded = np.zeros(len(body) + 2 * n, np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds) + 2)
    if n:
        padded[ends - 1], padded[np.concatenate([[0], ends[:-1]])] = 3, 2
        padded[np.arange(len(body)) + 2 * np.repeat(np.arange(n), np.diff(bounds)) + 1] = body
    for size in sizes:
        h = windows(padded, size)
        whole = owner[: len(h)] == owner[size - 1 :][: len(h)]
        key = mix(h[whole] + np.uint64(size)) >> shift
        out.append(Terms(owner[: len(h)][whole], key.astype(np.int32)))
    return out


def owner_sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` for each owner (ascending)."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[starts]] = np.add.reduceat(values, starts, axis=0)
    return out
