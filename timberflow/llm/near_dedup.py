"""Near duplicates by MinHash bands and sequential Bayesian verification.

Texts with equal shingle sets form a class; classes meet in the buckets of
their signature bands. Every class is first compared with one hub of each of
its buckets. Where a bucket then still holds several components, its classes
are compared in blocks of bounded size, each pair only in the first bucket that
it shares, and a block joins components as it goes. Each comparison goes through the
signature in batches and stops as soon as the posterior probability of reaching
the threshold falls below ``MISS``; what remains is checked on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from timberflow.llm.components import components
from timberflow.llm.texts import hashes, mix, plain, slices, windows, words
from timberflow.session import stored

MISS = 1e-4
BATCH = 16
BLOCK, FULL_BLOCK = 1024, 256  # classes of a block: with signatures, with full sets


class Bands:
    """Number and width of the bands: the widest of which at most 24 miss a
    pair at the threshold with a probability of at most ``MISS``."""

    def __init__(self, percent: int):
        t = percent / 100
        for width in range(12, 0, -1):
            number = math.ceil(math.log(MISS) / math.log1p(-(t**width))) if t < 1 else 1
            if number <= 24:
                break
        self.width, self.number, self.size = width, number, width * number
        self.least = np.zeros(self.size + 1, np.int64)  # matches needed after so many values
        for k in range(1, self.size + 1):
            tail, m = 0.0, 0
            while True:
                tail += math.comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
                if tail >= MISS:
                    break
                m += 1
            self.least[k] = m
        rng = np.random.default_rng(20_011)
        self.scale = rng.integers(1, 1 << 63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, self.size, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), 4096):
            np.minimum(out, (shingles[at : at + 4096, None] * self.scale + self.shift).min(0), out)
        return (out >> np.uint64(32)).astype(np.uint32)

    def likely(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of two signature matrices that may reach the threshold, and
        their matches; batch by batch, dropping a row once it is unlikely."""
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for at in range(0, self.size, BATCH):
            end = min(at + BATCH, self.size)
            matches[alive] += (a[alive, at:end] == b[alive, at:end]).sum(1)
            alive = alive[matches[alive] >= self.least[end]]
        return alive, matches[alive]


@lru_cache(maxsize=4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct ``size``-word shingles; of
    its whole word sequence when it has fewer words. A-Z count as a-z."""
    found = words(pc.ascii_lower(texts))
    h = hashes(found.vocab)[found.codes]
    at = windows(np.append(h, np.zeros(size, np.uint64)), size)
    bounds = found.offsets.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            yield np.unique(at[a : b - size + 1])
        elif b > a:  # as a window padded with a value that no word has
            yield windows(np.append(h[a:b], np.full(size - (b - a), b - a, np.uint64)), size)
        else:
            yield np.empty(0, np.uint64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint32).reshape(len(column), width)


def _text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, text_key, n (shingles), node (digest of the set, null without words)
    and sig."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key"))

    def run(batches):
        plan = bands(percent)
        for part in slices(batches, "text"):
            n, node, sig = [], [], []
            for found in shingle_sets(plain(part.column("text")), size):
                n.append(len(found))
                node.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sig.append(plan.signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("text_key"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
                ["id", "text_key", "n", "node", "sig"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_key binary, n bigint, node binary, sig binary")


def _band_rows(classes: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        plan = bands(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig"), plan.size).astype(np.uint64)
            salt = (np.arange(plan.number, dtype=np.uint64) << np.uint64(32)) + np.uint64(1)
            key = np.repeat(salt[None, :], len(sig), 0)
            for j in range(plan.width):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, j :: plan.width][:, : plan.number])
            node = batch.column("node").take(pa.array(np.repeat(np.arange(len(sig)), plan.number)))
            band = pa.array(np.tile(np.arange(plan.number, dtype=np.int32), len(sig)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), band, node], ["key", "band", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key bigint, band int, node binary")


def _likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    sig = classes.select("node", "sig")
    both = pairs.join(sig.toDF("b", "sig_b"), "b").join(sig.toDF("a", "sig_a"), "a")

    def run(batches):
        plan = bands(percent)
        for batch in batches:
            if batch.num_rows:
                keep, _ = plan.likely(
                    _matrix(batch.column("sig_a"), plan.size), _matrix(batch.column("sig_b"), plan.size)
                )
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(run, "a binary, b binary")


def _full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """The shingle sets (``items``) of some classes, from one document each."""
    needed = classes.join(nodes, "node", "left_semi").select("rep")
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(needed, "rep", "left_semi")

    def sets(batches):
        for part in slices(batches, "text"):
            found = [s.tobytes() for s in shingle_sets(plain(part.column("text")), size)]
            node = [xxhash.xxh3_128_digest(s) if s else None for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(found, pa.binary())], ["node", "items"])

    full = rows.select("text").mapInArrow(sets, "node binary, items binary").filter("node IS NOT NULL")
    return stored(full.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("items").alias("items")), "sets")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _links(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes whose full shingle sets reach the threshold."""
    both = pairs.join(full.toDF("b", "items_b"), "b").join(full.toDF("a", "items_a"), "a")

    def exact(batches):
        for part in slices(batches, "items_b"):
            sets = zip(part.column("items_a"), part.column("items_b"), strict=True)
            keep = [_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for pair in sets]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(exact, "a binary, b binary")


def _in_blocks(rows: DataFrame, size: int, work, schema: str) -> DataFrame:
    """``work`` on each block of a bucket and on each two blocks together, of
    about ``size`` rows each; rows (key, m, node and others) stream through,
    sorted by block."""
    parts = F.ceil(F.col("m") / size).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "m")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            place = np.stack([table[c].to_numpy() for c in ("key", "lo", "hi")])
            edge = [0, *(np.flatnonzero((np.diff(place, axis=1) != 0).any(0)) + 1).tolist()]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield work(table.slice(a, b - a).combine_chunks())
            held = table.slice(edge[-1])
        if held is not None and held.num_rows:
            yield work(held.combine_chunks())

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(run, schema)


def _column(part: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(part[name].chunks)


def _likely_here(part: pa.Table, plan: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs of a block (places i and j) of different components that
    share no earlier band, the most similar ones first; and the components."""
    sig, side = _matrix(_column(part, "sig"), plan.size), part["block"].to_numpy()
    comp = _column(part, "comp").dictionary_encode().indices.to_numpy()
    cross, band = part["lo"][0].as_py() != part["hi"][0].as_py(), part["band"][0].as_py()
    found = []
    for at in range(0, len(sig), 64):
        i, j = np.meshgrid(np.arange(at, min(at + 64, len(sig))), np.arange(len(sig)), indexing="ij")
        pick = (i < j) & (comp[i] != comp[j])
        if cross:
            pick &= side[i] != side[j]
        i, j = i[pick], j[pick]
        keep, matches = plan.likely(sig[i], sig[j])
        i, j = i[keep], j[keep]
        bands_equal = (sig[i] == sig[j]).reshape(-1, plan.number, plan.width).all(2)
        first = bands_equal.argmax(1) == band
        found.append(np.stack([i[first], j[first], matches[first]]))
    i, j, matches = np.concatenate(found, 1)
    order = np.argsort(-matches, kind="stable")
    return i[order], j[order], comp, sig


def _settle(left: DataFrame, percent: int, where: tuple) -> DataFrame:
    """Links between the components of mixed buckets; enough of them to join
    all components that any of their pairs links."""
    docs, classes, id_col, text_col, size = where
    sig = classes.select("node", "sig")

    def likely(part: pa.Table) -> pa.RecordBatch:
        i, j, *_ = _likely_here(part, bands(percent))
        part = part.take(pa.array(np.unique(np.concatenate([i, j]))))
        return pa.RecordBatch.from_arrays([_column(part, n) if len(part) else pa.array([], part.schema.field(n).type) for n in ("key", "band", "node", "comp")], ["key", "band", "node", "comp"])

    def link(part: pa.Table) -> pa.RecordBatch:
        i, j, comp, _ = _likely_here(part, bands(percent))
        items, root, a, b = _column(part, "items"), list(range(len(part))), [], []

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(comp[p]), find(comp[q])
            if x != y and _linked(*(np.frombuffer(items[k].as_buffer(), np.uint64) for k in (p, q)), percent):
                root[x] = y
                a.append(p)
                b.append(q)
        node = _column(part, "node")
        return pa.RecordBatch.from_arrays([node.take(pa.array(x, pa.int64())) for x in (a, b)], ["a", "b"])

    near = _in_blocks(left.join(sig, "node"), BLOCK, likely, "key bigint, band int, node binary, comp binary")
    near = stored(near.distinct(), "near")
    full = _full_sets(near.select("node").distinct(), docs, classes, id_col, text_col, size)
    near = near.join(near.groupBy("key").agg(F.count("*").alias("m")), "key").join(sig, "node").join(full, "node")
    return _in_blocks(near, FULL_BLOCK, link, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    Two texts are linked when 100 times the shared shingles reach ``percent``
    times all shingles of both. component_id is the smallest id reachable over
    links; kept marks rows whose id it is. Null, empty and wordless texts have
    0 shingles and are linked with nothing, and so are rows with a null id
    (component_id null, kept true). Repeated ids keep a row each; equal sets
    are always linked. Other columns are not read. A pair at the threshold is
    missed with a probability of about ``2 * MISS``.
    """
    out = _grouped(docs, id_col, text_col, size, percent)
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Per row of ``docs``: id, text_key, n, and of its component ``comp`` (a
    class of it) and component_id; null for rows that are linked with nothing."""
    done = stored(sketches(docs, id_col, text_col, size, percent), "sketches")
    known = done.filter("node IS NOT NULL AND id IS NOT NULL")
    classes = stored(
        known.groupBy("node").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes"
    )
    where = (docs, classes, id_col, text_col, size)
    rows = _band_rows(classes, percent)
    buckets = stored(
        rows.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).filter("m > 1"), "buckets"
    )
    met = stored(rows.join(buckets, "key").filter("node <> hub"), "met")
    stars = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    likely = stored(_likely_pairs(stars, classes, percent), "likely")
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    comps = components(_links(likely, _full_sets(ends, *where), percent))
    # hubs are settled with all of their bucket; the others may still differ
    left = met.filter("m > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    left = stored(left.select("key", "band", "m", "node", "comp"), "left")
    mixed = left.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q").select("key")
    fresh = stored(_settle(left.join(mixed, "key", "left_semi"), percent, where), "linked")
    if not fresh.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(fresh))
    named = classes.select("node", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp").select("node", "comp", "component_id")
    rows = done.select("id", "text_key", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"))
    return rows.join(named, "node", "left").drop("node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that with
    the smallest id (and of its texts the one with the smallest digest).
    Documents are told apart by id and text: another text with the id of a
    dropped one stays. Rows that repeat an id and its text stay once; rows with
    a null id stay all."""
    decided = stored(_grouped(docs, id_col, text_col, size, percent).select("id", "text_key", "comp"), "decided")
    member = decided.filter("comp IS NOT NULL").distinct()
    first = member.groupBy("comp").agg(F.min(F.struct("id", "text_key")).alias("first")).select("first.*")
    gone = member.select("id", "text_key").join(first, ["id", "text_key"], "left_anti").toDF("__gone_id", "__gone_key")
    left = docs.join(gone, (docs[id_col] == F.col("__gone_id")) & (_text_key(text_col) == F.col("__gone_key")), "left_anti")
    twice = decided.filter("id IS NOT NULL").groupBy(F.col("id").alias(id_col)).count().filter("count > 1").select(id_col)
    if twice.isEmpty():
        return left
    repeated = left.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(docs.columns)
    return left.join(twice, id_col, "left_anti").select(docs.columns).unionAll(repeated)
