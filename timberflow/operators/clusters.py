"""Duplicate clustering of log messages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from timberflow.functions.levels import inferred_severity
from timberflow.functions.masks import normalized_text
from timberflow.functions.text import filled, let, non_empty, strip
from timberflow.operators.pinning import pin
from timberflow.session import stored

# Join threshold, samples kept, summary wording and lengths.
THRESHOLD = 0.92
SAMPLES = 5
BLOCK = 1 << 14  # rows of a bucket that are compared in one piece
TASK_BYTES = 128 << 20  # vectors that a task of a comparison reads, about
SUMMARY_PREFIXES = {
    "critical": "Critical cluster",
    "error": "Error cluster",
    "warn": "Warning cluster",
    "info": "Info cluster",
}


def exact_text_groups(
    logs: DataFrame, text: str = "message", ts: str = "ts", tie: str = "log_id"
) -> DataFrame:
    """Group logs whose normalised texts are equal: the common case of
    clustering, one hash aggregation with map-side combine."""
    keyed = pin(logs, {"__text": normalized_text(F.col(text))}).filter("__text <> ''")
    arrival = F.struct(ts, tie)
    return (
        keyed.groupBy(F.sha2("__text", 256).alias("text_key"))
        .agg(
            F.count("*").alias("occurrence_count"),
            F.min_by(tie, arrival).alias("first_log_id"),
            F.min_by(text, arrival).alias("representative_log"),
            F.min(ts).alias("first_seen"),
            F.max(ts).alias("last_seen"),
        )
    )


def _signatures(vector: Column, tables: int, bits: int, seed: int) -> Column:
    """``array<bigint>``: per table, the side of ``bits`` random hyperplanes
    the vector lies on. Similar vectors agree in a table with probability
    ``(1 - angle / pi) ** bits``."""
    @F.pandas_udf("array<bigint>")
    def sides(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        width = max(len(v) for v in vectors)
        # Row by row, so a longer vector in a batch leaves the first rows alone.
        planes = np.random.default_rng(seed).standard_normal((width, tables * bits))
        stacked = np.zeros((len(vectors), width))
        for row, v in enumerate(vectors):
            stacked[row, : len(v)] = v
        on_side = (stacked @ planes > 0).reshape(len(vectors), tables, bits)
        packed = on_side @ (1 << np.arange(bits, dtype="int64"))
        return pd.Series(list(packed))

    return sides(vector)


def hashing_plan(threshold: float, recall: float = 0.95, aim: int = 24) -> tuple[int, int]:
    """(tables, bits), the same for a table of any size: the most bits with
    which at most ``aim`` tables make a pair at the threshold meet with
    probability ``recall``. With one bit the number of tables is whatever the
    recall needs."""
    agree = 1 - math.acos(min(1.0, max(0.0, threshold))) / math.pi
    for bits in range(62, 0, -1):
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(1 - 1e-12, agree**bits))))
        if tables <= aim:
            break
    return tables, bits


def _packed(vector: Column) -> Column:
    """``binary``: the vector's numbers, exactly. A vector of counts has few
    distinct numbers, which are listed once, with 4 or 8 bits a place; others
    stand as they are. Read by :func:`_unpacked`."""
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        def one(v) -> bytes:
            full = np.asarray(v, "float64")
            with np.errstate(over="ignore"):
                half = full.astype("float32")
            numbers = half if np.array_equal(half, full, equal_nan=True) else full
            listed, at = np.unique(numbers, return_inverse=True)
            bits = 4 if len(listed) <= 16 else 8
            if len(listed) > 256 or len(listed) * numbers.itemsize + len(full) * bits / 8 >= numbers.nbytes:
                bits, listed, places = 0, listed[:0], numbers.tobytes()
            else:
                places = at.astype("u1")
                if bits == 4:
                    places = np.append(places, np.zeros(len(places) % 2, "u1"))
                    places = places[::2] | places[1::2] << 4
                places = places.tobytes()
            head = np.array([bits, numbers.itemsize, len(listed), len(full)], "<u4")
            return head.tobytes() + listed.tobytes() + places

        return pd.Series([one(v) for v in vectors], dtype=object)

    return pack(vector)


def _unpacked(rows: pa.Array) -> np.ndarray:
    """The vectors of :func:`_packed`, shorter ones filled with zeros."""
    rows = rows.cast(pa.binary())
    ends = np.frombuffer(rows.buffers()[1], "<i4")[rows.offset : rows.offset + len(rows) + 1].astype("int64")
    data = np.frombuffer(rows.buffers()[2], "u1")
    heads = data[ends[:-1, None] + np.arange(16)].view("<u4")
    kinds, kind_of = np.unique(heads, axis=0, return_inverse=True)
    out = np.zeros((len(rows), int(kinds[:, 3].max())), f"float{8 * kinds[:, 1].max()}")
    for k, (bits, itemsize, listed, count) in enumerate(kinds.tolist()):
        mine = np.flatnonzero(kind_of.ravel() == k)
        size = listed * itemsize + (-(-count * bits // 8) if bits else count * itemsize)
        body = data[ends[mine, None] + 16 + np.arange(size)]
        numbers = np.ascontiguousarray(body[:, : listed * itemsize] if bits else body).view(f"<f{itemsize}")
        if bits:
            at = body[:, listed * itemsize :]
            if bits == 4:
                at = np.stack([at & 15, at >> 4], axis=2).reshape(len(mine), -1)[:, :count]
            numbers = np.take_along_axis(numbers, at.astype("int64"), axis=1)
        out[mine, :count] = numbers
    return out


class _Cell:
    """Rows that meet, in order of arrival: their numbers, whether they are
    leaders (``fixed``) and of the second block (``high``), and the vectors."""

    def __init__(self, item: np.ndarray, fixed: np.ndarray, high: np.ndarray, vectors: np.ndarray):
        self.item, self.fixed, self.high, self.vectors = item, fixed, high, vectors
        self.rough = np.empty(vectors.shape, "float32")
        for at in range(0, len(vectors), 1024):
            self.rough[at : at + 1024] = self.unit(slice(at, at + 1024))

    def unit(self, at) -> np.ndarray:
        rows = self.vectors[at].astype("float64")
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)

    def exact(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Scores, rounded so that it does not matter in which cell a pair meets."""
        return np.round(np.clip(self.unit(own) @ self.unit(other).T, 0.0, 1.0), 12)

    def likely(self, threshold: float):
        """Rows that are no leaders, up to 256 at a time, with the rows before
        them, and by 32-bit products which of these may be similar and which
        are for certain. In a cell of two blocks only pairs across them count."""
        every = np.arange(len(self.item))
        low, high = every[~self.high], every[self.high]
        slack = (self.vectors.shape[1] + 16) * 2.0**-22
        for mine, others in [(low, high), (high, low)] if len(low) and len(high) else [(every, every)]:
            mine = mine[~self.fixed[mine]]
            theirs = self.rough if len(others) == len(every) else self.rough[others]
            for at in range(0, len(mine), 256):
                own = mine[at : at + 256]
                upto = int(np.searchsorted(others, own[-1]))  # rows are in order of arrival
                if upto:
                    earlier, scores = others[:upto] < own[:, None], self.rough[own] @ theirs[:upto].T
                    maybe = earlier & (scores >= np.float32(threshold - slack)) if threshold > slack else earlier
                    yield own, others[:upto], maybe, maybe & (scores >= np.float32(threshold + slack))

    def pairs(self, threshold: float):
        """Rows that are no leaders, earlier rows, their scores and which of
        these reach the threshold; rows with none may be left out."""
        for own, other, maybe, _ in self.likely(threshold):
            rows, columns = maybe.any(1), maybe.any(0)
            if rows.any():
                scores = self.exact(own[rows], other[columns])
                yield own[rows], other[columns], scores, (scores >= threshold) & maybe[np.ix_(rows, columns)]

    def met(self, threshold: float) -> np.ndarray:
        """Whether a row is similar to another; there are no leaders."""
        met = np.zeros(len(self.item), bool)
        for own, other, maybe, sure in self.likely(threshold):
            met[own] |= sure.any(1)
            met[other] |= sure.any(0)
            # scores are only needed where one of the two is not known yet
            maybe &= ~(met[own][:, None] & met[other])
            rows, columns = maybe.any(1), maybe.any(0)
            if rows.any():
                near = (self.exact(own[rows], other[columns]) >= threshold) & maybe[np.ix_(rows, columns)]
                met[own[rows]] |= near.any(1)
                met[other[columns]] |= near.any(0)
        return met


def _met(
    active: DataFrame, leaders: DataFrame | None, block: int, among: bool, tasks: int | None, judge, returned: str
) -> DataFrame:
    """What ``judge(table, cell)`` yields for the cells, as columns ``returned``.

    ``item`` numbers the rows in order of arrival. A row goes to its bucket in
    each table (null in ``sigs``: to none of this table) where it meets
    somebody: active items meet leaders and, ``among`` themselves, one another.
    A bucket of more than ``block`` rows is cut into blocks of active items and
    blocks of leaders; every two blocks that have something to compare meet in
    a cell, so a cell is bounded and nothing of a bucket is left out. ``tasks``
    share the cells (see :func:`_tasks`).
    """
    columns = ["item", "vec", "sigs"]
    rows = active.select(*columns, F.lit(False).alias("fixed"))
    if leaders is not None:
        rows = rows.unionByName(leaders.select(*columns, F.lit(True).alias("fixed")))
    keys = rows.select("item", "fixed", F.posexplode("sigs").alias("tab", "sig")).filter("sig is not null")
    sizes = keys.groupBy("tab", "sig").agg(F.count_if(~F.col("fixed")).alias("n_active"), F.count_if("fixed").alias("n_fixed"))
    sizes = sizes.filter("n_active > 0 and n_active + n_fixed > 1" if among else "n_active > 0 and n_fixed > 0")
    whole = F.col("n_active") + F.col("n_fixed") <= block
    parts = lambda n: F.when(whole, 1).otherwise(F.ceil(F.col(n) / block)).cast("int")
    sizes = sizes.select("tab", "sig", whole.alias("whole"), parts("n_active").alias("a"), parts("n_fixed").alias("f"))
    # keys find their buckets alone; a vector meets its list of them once
    found = keys.join(sizes, ["tab", "sig"]).groupBy("item").agg(F.collect_list(F.struct("tab", "sig", "whole", "a", "f")).alias("buckets"))
    placed = rows.drop("sigs").join(found, "item").select("item", "vec", "fixed", F.inline("buckets"))
    # blocks 0 to a - 1 hold active items, a to a + f - 1 leaders
    dealt = F.when(F.col("fixed"), F.col("a") + F.pmod(F.xxhash64("item"), F.greatest("f", F.lit(1)))).otherwise(F.pmod(F.xxhash64("item"), "a"))
    placed = placed.withColumn("block", F.when(F.col("whole"), 0).otherwise(dealt).cast("int"))
    first = F.lit(0) if among else F.col("a")
    others = (
        F.when(F.col("whole"), F.array(F.lit(0)))
        .when(F.col("fixed"), F.sequence(F.lit(0), F.col("a") - 1))
        .otherwise(F.filter(F.sequence(F.lit(0), F.col("a") + F.col("f") - 1), lambda k: k >= first))
    )
    # a cell's columns are sent with each of its rows, so there are few: table
    # and blocks in one number, marks of a leader and of the second block in one
    lo, hi = (f("block", "other").cast("bigint") for f in (F.least, F.greatest))
    cells = placed.withColumn("other", F.explode(others)).select(
        "sig",
        F.shiftleft(F.col("tab").cast("bigint"), 48).bitwiseOR(F.shiftleft(lo, 24)).bitwiseOR(hi).alias("place"),
        F.when(F.col("fixed"), 1).otherwise(0).bitwiseOR(F.when(F.col("block") > F.col("other"), 2).otherwise(0)).alias("marks"),
        "item",
        "vec",
    )

    def run(batches):
        def judged(key, pieces):
            if sum(len(item) for item, _, _ in pieces) < 2:
                return
            item, marks, vectors = zip(*pieces, strict=True)
            width = max(v.shape[1] for v in vectors)
            vectors = [v if v.shape[1] == width else np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors]
            marks = np.concatenate(marks)
            yield from judge(key[1] >> 48, _Cell(np.concatenate(item), marks & 1 > 0, marks & 2 > 0, np.concatenate(vectors)))

        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            item, marks, sig, place = (batch[c].to_numpy() for c in ("item", "marks", "sig", "place"))
            vectors = _unpacked(batch["vec"])
            edge = [0, *(np.flatnonzero((np.diff(sig) != 0) | (np.diff(place) != 0)) + 1).tolist(), len(sig)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                now = int(sig[a]), int(place[a])
                if now != key:
                    yield from judged(key, held)
                    key, held = now, []
                held.append((item[a:b], marks[a:b], vectors[a:b]))
        yield from judged(key, held)

    dealt_out = cells.repartition(tasks, "sig", "place") if tasks else cells.repartition("sig", "place")
    return dealt_out.sortWithinPartitions("sig", "place", "item").mapInArrow(run, returned)


def _look_back(
    active: DataFrame, leaders: DataFrame | None, threshold: float, block: int, among: bool, tasks: int | None = None
) -> DataFrame:
    """Per active item and cell where it has an earlier similar row of one of
    its buckets: whether one is a leader (``led``; ``parent`` is the most
    similar one, the earlier one on a tie), and whether one is active
    (``waits``, only when compared ``among`` themselves). See :func:`_met`."""

    def judge(_, cell):
        for own, other, scores, near in cell.pairs(threshold):
            lead = near & cell.fixed[other]
            led, waits = lead.any(1), (near & ~cell.fixed[other]).any(1) & among
            best = np.where(lead, scores, -1.0).argmax(1)
            keep = np.flatnonzero(led | waits)
            if len(keep):
                score, parent = scores[keep, best[keep]], cell.item[other[best[keep]]]
                columns = [pa.array(cell.item[own[keep]]), pa.array(led[keep]), pa.array(waits[keep])]
                columns += [pa.array(x, mask=~led[keep]) for x in (parent, score)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "led", "waits", "parent", "score"])

    return _met(active, leaders, block, among, tasks, judge, "item bigint, led boolean, waits boolean, parent bigint, score double")


def _company(items: DataFrame, threshold: float, block: int, tasks: int | None = None) -> DataFrame:
    """The items that have a similar one in any of their buckets, with ``sigs``
    only of the tables where they meet one: the same similar pairs, in fewer
    cells."""

    def judge(tab, cell):
        met = cell.met(threshold)
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(cell.item[met]), pa.array(np.full(met.sum(), tab, "int32"))], ["item", "tab"])

    met = _met(items, None, block, True, tasks, judge, "item bigint, tab int").groupBy("item").agg(F.collect_set("tab").alias("tabs"))
    kept = F.transform("sigs", lambda sig, tab: F.when(F.array_contains("tabs", tab), sig))
    return items.join(met, "item").withColumn("sigs", kept).drop("tabs")


def _tasks(count: int, width: float, tables: int, bits: int, block: int, least: int) -> int | None:
    """Tasks for the cells of ``count`` vectors of ``width`` numbers, so that
    each reads about ``TASK_BYTES`` of them; null where the session's own
    number is enough."""
    copies = math.ceil(count / 2**bits / block)
    size = 4.0 * count * width * tables * copies
    return max(least, math.ceil(size / TASK_BYTES)) if size > 8 * TASK_BYTES else None


def _phases(items: DataFrame, count: int, block: int, sample: int = 4096) -> tuple[DataFrame, int]:
    """``items`` with ``phase``, and the number of phases: stretches of the
    order of arrival, each about eight times as long as all before it. The
    result does not depend on them."""
    shares = []
    size = float(max(1, block))
    while size < count:
        shares.append(min(sample, count) * size / count)
        size *= 8
    if not shares:
        return items.withColumn("phase", F.lit(0)), 1
    drawn = items.select("item").orderBy(F.xxhash64("item"), "item").limit(sample)
    cuts = drawn.agg(F.array_sort(F.collect_list("item")).alias("o")).select(F.array(*(F.get("o", F.lit(int(k))) for k in shares)).alias("cuts"))
    passed = F.filter("cuts", lambda cut: cut < F.col("item"))
    return items.crossJoin(F.broadcast(stored(cuts, "cuts"))).withColumn("phase", F.size(passed)).drop("cuts"), len(shares) + 1


def assign_clusters(
    logs: DataFrame,
    threshold: float = THRESHOLD,
    vector: str = "vector",
    text: str = "message",
    ts: str = "ts",
    tie: str = "log_id",
    block: int = BLOCK,
    tables: int | None = None,
    bits: int | None = None,
    seed: int = 7,
) -> DataFrame:
    """Leader clustering of whole tables: adds ``cluster_id, is_duplicate,
    similarity_score``.

    Logs are taken in order of ``ts`` and ``tie``: one starts a cluster when no
    earlier leader is similar enough, otherwise it joins the most similar of
    them. Leaders keep their own vector. Logs are compared when they share a
    hash bucket; :func:`hashing_plan` gives the recall per pair at the
    threshold, by one rule for tables of any size, and the result does not
    depend on ``block``. A member's score is its exact cosine.

    Equal vectors collapse first; the others are numbered in order of arrival
    and sent packed. They are settled in phases, each a longer stretch of the
    order of arrival, and within a phase in rounds: who has no earlier similar
    open item and no leader is a leader, who has a leader is settled, the
    others go to the next round. The earliest open item is settled in every
    round. After a phase, later items that its leaders lead drop out, so near
    copies are not compared with one another. Where the first phase shows that
    most items lead, all are compared once to find those that have a similar
    one at all; only these go on, to the tables where they met one. Neither
    changes the result. Each round is cut to reliable storage. Logs with a
    blank text or no vector stay without a cluster.
    """
    usable = filled(F.col(text)).isNotNull() & (F.size(vector) > 0)
    # 128 bits of hash identify equal vectors without shuffling them twice.
    key = F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(seed), F.col(vector))))
    keyed = logs.withColumn("__item", F.when(F.coalesce(usable, F.lit(False)), key))
    arrival = F.struct(F.col(ts).alias("at"), F.col(tie).alias("id"))
    planned_tables, planned_bits = hashing_plan(threshold)
    bits = planned_bits if bits is None else bits
    tables = planned_tables if tables is None else tables
    sigs = _signatures(F.col("vec"), tables, bits, seed) if bits else F.array(F.lit(0).cast("bigint"))
    distinct = (
        keyed.filter("__item is not null")
        .groupBy("__item")
        .agg(F.min(arrival).alias("first"), F.first(vector).alias("vec"))
        .select("__item", "first.at", "first.id", "vec")
    )
    # partitions are ranges, so the numbers rise with the order of arrival
    numbered = distinct.repartitionByRange("at", "id", "__item").sortWithinPartitions("at", "id", "__item").select(
        F.monotonically_increasing_id().alias("item"), "__item", "id", F.size("vec").alias("width"),
        _packed(F.col("vec")).alias("vec"), sigs.alias("sigs"),
    )
    named = stored(numbered, "items")
    id_type = named.schema["id"].dataType.simpleString()
    settled = ["item", "vec", "sigs"]
    count, numbers = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0))).first()
    tasks = _tasks(count, numbers / max(1, count), tables, bits, block, int(logs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    items, phases = _phases(named.select(settled), count, block)
    waiting, leaders = items, None
    for phase in range(phases):
        active, later = waiting.filter(F.col("phase") == phase), waiting.filter(F.col("phase") > phase)
        fresh = found = None
        while True:
            told = _look_back(active, fresh, threshold, block, True, tasks).groupBy("item").agg(F.bool_or("led").alias("led"))
            seen = stored(active.select(settled).join(told, "item", "left"), "round")
            fresh = seen.filter("led is null").select(settled)
            found = fresh if found is None else found.unionByName(fresh)
            active = seen.filter(~F.col("led")).select(settled)
            if active.isEmpty():
                break
        if phase == 0 and phases > 1 and 2 * found.count() > items.filter("phase = 0").count():
            items = stored(_company(items, threshold, block, tasks), "company")
            found = items.join(found.select("item"), "item", "left_semi").select(settled)
            later = items.filter(F.col("phase") > phase)
        leaders = found if leaders is None else leaders.unionByName(found)
        if phase + 1 < phases:
            led = _look_back(later, found, threshold, block, False, tasks).select("item").distinct()
            waiting = stored(later.join(led, "item", "left_anti"), "later")

    # The most similar leader, the earlier one on a tie. Who is no member leads.
    preference = F.struct((-F.col("score")).alias("s"), "parent")
    members = items.join(leaders.select("item"), "item", "left_anti")
    members = stored(
        _look_back(members, leaders, threshold, block, False, tasks)
        .groupBy("item")
        .agg(F.min_by(F.struct("parent", "score"), preference).alias("top"))
        .select("item", "top.parent", "top.score"),
        "members",
    )
    decided = named.select("__item", "item").join(members, "item", "left").select(
        "__item", F.coalesce("parent", "item").alias("leader"), F.col("score").alias("__score")
    )
    names = named.select(F.col("item").alias("leader"), F.col("id").alias("__leader"))
    decided = decided.join(names, "leader").drop("leader")

    is_first = F.col(tie) == F.col("__leader")
    clustered = F.col("__leader").isNotNull()
    # Logs without an item have one and the same null key: they pass by the join.
    apart = keyed.filter("__item is null").withColumns(
        {"__leader": F.lit(None).cast(id_type), "__score": F.lit(None).cast("double")}
    )
    placed = keyed.filter("__item is not null").join(decided, "__item", "left").unionByName(apart)
    return (
        placed.withColumns(
            {
                "cluster_id": F.when(
                    clustered, F.concat(F.lit("cluster-"), F.md5(F.col("__leader").cast("string")))
                ),
                "is_duplicate": clustered & ~F.coalesce(is_first, F.lit(False)),
                # Equal to the leader scores 1; the leader itself found nothing.
                "similarity_score": F.when(~clustered | is_first, F.lit(0.0)).otherwise(
                    F.coalesce("__score", F.lit(1.0))
                ),
            }
        )
        .drop("__item", "__leader", "__score")
    )


def cluster_table(
    decisions: DataFrame,
    text: str = "message",
    service: str = "service_id",
    ts: str = "ts",
    tie: str = "log_id",
    samples: int = SAMPLES,
) -> DataFrame:
    """One row per cluster from rows with ``cluster_id, is_duplicate,
    similarity_score``.

    Samples are the latest texts first seen in the cluster, newest first. The
    running average counts the first duplicate's score twice, because a new
    cluster's stored 0 is read back as "none yet".
    """
    clustered = decisions.filter("cluster_id is not null").withColumn("__text", strip(F.col(text)))
    arrival = F.struct(ts, tie)
    joined = F.col("is_duplicate")
    summary = clustered.groupBy("cluster_id").agg(
        F.count("*").alias("occurrence_count"),
        F.min_by("__text", arrival).alias("representative_log"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.min_by(F.when(joined, F.col("similarity_score")), F.when(joined, arrival)).alias("__first_score"),
        F.sum(F.when(joined, F.col("similarity_score"))).alias("__scores"),
        F.min_by(non_empty(F.col(service)), F.when(non_empty(F.col(service)).isNotNull(), arrival)).alias("service_name"),
    ).withColumn(
        "similarity_score_average",
        F.coalesce((F.col("__first_score") + F.col("__scores")) / F.col("occurrence_count"), F.lit(0.0)),
    )
    # Distinct texts combine before the shuffle, and the rank filter keeps at
    # most `samples` rows per cluster and task.
    texts = clustered.groupBy("cluster_id", "__text").agg(F.min(arrival).alias("__seen"))
    newest = W.partitionBy("cluster_id").orderBy(F.desc("__seen"))
    kept = (
        texts.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= samples)
        .groupBy("cluster_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__text"))), lambda e: e["__text"]).alias("sample_logs"))
    )
    return summary.join(kept, "cluster_id").drop("__first_score", "__scores")


def cluster_summary(representative: Column) -> Column:
    """Readable one-line summary of a representative text."""

    def worded(text: Column, cleaned: Column) -> Column:
        severity = inferred_severity(text)
        prefix = F.lit(None).cast("string")
        for name, words in SUMMARY_PREFIXES.items():
            prefix = F.when(severity == name, words).otherwise(prefix)
        return (
            F.when(text == "", "Unclassified cluster")
            .when(cleaned == "", F.substring(text, 1, 160))
            .otherwise(F.concat(prefix, F.lit(": "), F.substring(cleaned, 1, 120)))
        )

    def of_text(text: Column) -> Column:
        cleaned = F.regexp_replace(text, r"(?i)^(error|warn|warning|critical|info)\s*[:\-\s]*", "")
        cleaned = F.regexp_replace(cleaned, r"(?i)\b(?:0x)?[a-f0-9]{6,}\b", "")
        cleaned = F.regexp_replace(cleaned, r"\b\d+\b", "")
        cleaned = strip(F.regexp_replace(cleaned, r"(?U)\s+", " "))
        return let(cleaned, lambda bound: worded(text, bound))

    return let(normalized_text(representative), of_text)


def cluster_label(service: Column, cluster_id: Column) -> Column:
    return F.coalesce(F.concat(non_empty(service), F.lit(":"), cluster_id), cluster_id)


def reduction_percentage(occurrences: Column, total: Column) -> Column:
    """Share of all logs that are repeats in this cluster, 2 decimals."""
    ratio = F.least(F.lit(100.0), (occurrences - 1) * 100.0 / total)
    return F.when((total > 0) & (occurrences > 1), F.round(ratio, 2)).otherwise(F.lit(0.0))


def with_cluster_defaults(stored: DataFrame) -> DataFrame:
    """Fill the gaps of a stored cluster row the way a reader expects."""
    return stored.withColumns(
        {
            "occurrence_count": F.when(F.col("occurrence_count") != 0, F.col("occurrence_count")).otherwise(F.lit(1)),
            "sample_logs": F.coalesce("sample_logs", F.array().cast("array<string>")),
            "similarity_score_average": F.coalesce("similarity_score_average", F.lit(0.0)),
            "cluster_summary": F.coalesce("cluster_summary", F.lit("")),
            "duplicate_reduction_percentage": F.coalesce("duplicate_reduction_percentage", F.lit(0.0)),
            "last_seen": F.coalesce("last_seen", "first_seen"),
        }
    )


def cluster_statistics(clusters: DataFrame, total_logs: DataFrame | None = None) -> DataFrame:
    """Dashboard row per cluster. ``total_logs`` is a one-row, one-column
    DataFrame; by default the logs in the clusters given."""
    if total_logs is None:
        total_logs = clusters.agg(F.coalesce(F.sum("occurrence_count"), F.lit(0)))
    total = total_logs.scalar()
    label = cluster_label(F.col("service_name"), F.col("cluster_id"))
    rows = clusters.withColumns(
        {
            "__total": total,
            "cluster_summary": cluster_summary(F.col("representative_log")),
            "sample_count": F.size("sample_logs"),
            "similarity_score_average": F.round("similarity_score_average", 4),
            "cluster_label": label,
            "is_cluster": F.lit(True),
        }
    )
    return rows.withColumns(
        {
            "duplicate_reduction_percentage": reduction_percentage(F.col("occurrence_count"), F.col("__total")),
            "visualization_metadata": F.struct(
                F.when(F.col("occurrence_count") > 1, "duplicate").otherwise("new").alias("status"),
                let(normalized_text(F.col("representative_log")), inferred_severity).alias("severity"),
                "service_name",
                "occurrence_count",
                "cluster_label",
                "sample_count",
            ),
        }
    ).drop("__total")


def indexed_logs(decisions: DataFrame) -> DataFrame:
    """Only first members (and unclustered logs) are stored."""
    return decisions.filter(~F.col("is_duplicate"))


def decision_rows(decisions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per log: the decision and the state of its cluster."""
    return decisions.select("log_id", "cluster_id", "is_duplicate", "similarity_score").join(
        clusters.select(
            "cluster_id",
            "occurrence_count",
            "representative_log",
            "first_seen",
            "last_seen",
            "sample_logs",
            "similarity_score_average",
            "service_name",
        ),
        "cluster_id",
        "left",
    )
