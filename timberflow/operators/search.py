"""Exact cosine search over stored log vectors.

Scores are cosines over whole tables. One vector is compared in a scan that
shuffles nothing but each partition's best rows. For a table of queries the
base is dealt into splits of bounded size. A task holds one split, grouped round
pivots with the interval of angles to each; queries stream past it and are
compared with the groups that could still hold one of their k best rows. Only
ids and scores leave a split, and the payload joins the final ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from timberflow.functions.services import SERVICE_ID_PATTERN, UNKNOWN_SERVICE, valid_service_id

SPLIT, SMALL_SPLIT = 1 << 16, 1 << 10  # base rows that a task holds: at most about, and worth a task of their own
SCORES = 4_000_000  # numbers in one matrix of scores
QUERIES = 1 << 10  # that are compared at a time
DENSE = 0.2  # share of the pairs from which one product of all is cheaper than products by pivot
SLACK = 1e-9  # of bounds, for rounding


def check_limit(limit: int, low: int = 1, high: int = 50) -> int:
    if not low <= limit <= high:
        raise ValueError(f"Result limit must be between {low} and {high}")
    return limit


def _by_length(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of the rows of each length; empty and null
    vectors are left out, null elements count as zero."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        place = np.flatnonzero(lengths == length)
        flat = vectors.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False).astype("float64")
        rows = np.nan_to_num(flat).reshape(-1, length)
        size = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        out[length] = place, rows / np.where(size > 0, size, 1.0)[:, None]
    return out


def _cosines(rows: pa.Array, queries: dict[int, tuple[np.ndarray, np.ndarray]], n_queries: int) -> np.ndarray:
    """Scores of all rows and queries; 0 where lengths differ."""
    scores = np.zeros((len(rows), n_queries))
    for length, (place, unit) in _by_length(rows).items():
        if length in queries:
            own, matrix = queries[length]
            scores[np.ix_(place, own)] = unit @ matrix.T
    return scores


def _candidates(scores: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and queries of the k best finite scores; with ties at the k-th."""
    wanted = np.isfinite(scores)
    if len(scores) > k:
        wanted &= scores >= np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] - slack
    return np.nonzero(wanted)


class _Group:
    """Vectors of one length round their pivots: sorted by the nearest pivot,
    with the least and the greatest angle to it."""

    def __init__(self, place: np.ndarray, unit: np.ndarray):
        self.pivots = unit[np.linspace(0, len(unit) - 1, min(len(unit), int(2 * np.sqrt(len(unit))) + 1)).astype(int)]
        nearest = np.empty(len(unit), np.int64)
        angle = np.empty(len(unit))
        step = max(1, SCORES // len(self.pivots))
        for at in range(0, len(unit), step):
            scores = unit[at : at + step] @ self.pivots.T
            nearest[at : at + step] = scores.argmax(1)
            angle[at : at + step] = np.arccos(np.clip(scores.max(1), -1, 1))
        order = np.argsort(nearest, kind="stable")
        self.place, self.unit = place[order], unit[order]
        self.small = self.unit.astype("float32")
        # what rounding to 32 bits can change in a product of unit vectors
        self.slack = SLACK + 2 * (unit.shape[1] + 4) * 2.0**-24
        used, first = np.unique(nearest[order], return_index=True)
        self.pivots, self.bounds = self.pivots[used], np.append(first, len(unit))
        self.low, self.high = (f.reduceat(angle[order], first) for f in (np.minimum, np.maximum))

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """The greatest cosine that a vector of each pivot can have with each
        query: by the triangle inequality the angle between them is at least
        that from the query's angle to the interval."""
        angle = np.arccos(np.clip(queries @ self.pivots.T, -1, 1))
        return np.cos(np.maximum(0, np.maximum(angle - self.high, self.low - angle))) + SLACK


class _Best:
    """The k best rows found so far for some queries, and the score that
    another row has to reach."""

    def __init__(self, unit: np.ndarray, k: int, floor: float, rank: np.ndarray):
        self.unit, self.k, self.floor, self.rank = unit, k, floor, rank
        self.query, self.row, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.kth = np.full(len(unit), floor)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def offer(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.kth[query]
        self.waiting.append((query[good], row[good], score[good]))
        self.n_waiting += int(good.sum())
        if self.n_waiting > SCORES // 8:
            self.settle()

    def meet(self, group: _Group, query: np.ndarray, at: np.ndarray) -> None:
        """Pairs of a query and a place in the group, compared pair by pair, so
        that equal vectors have equal scores."""
        step = max(1, SCORES // self.unit.shape[1])
        for i in range(0, len(query), step):
            own, other = query[i : i + step], at[i : i + step]
            self.offer(own, group.place[other], np.einsum("ij,ij->i", self.unit[own], group.unit[other]))

    def settle(self) -> None:
        parts = [(self.query, self.row, self.score), *self.waiting]
        query, row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((self.rank[row], -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.row, self.score = query[kept], row[order][kept], score[order][kept]
        last = place[kept] == self.k - 1
        self.kth[self.query[last]] = np.maximum(self.floor, self.score[last])
        self.waiting, self.n_waiting = [], 0


class _Split:
    """The base rows that a task holds."""

    def __init__(self, rows: pa.Table, k: int, scoped: bool, min_score: float | None):
        rows = rows.combine_chunks()
        self.ids, self.k = rows["id"].combine_chunks(), k
        self.rank = np.empty(len(rows), np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(rows))
        self.floor = -np.inf if min_score is None else min_score
        self.scoped = scoped
        self.of_scope: dict[str, np.ndarray] = {}
        if scoped:
            coded = rows["scope"].combine_chunks().dictionary_encode()
            of_row = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
            edges = np.searchsorted(np.sort(of_row), np.arange(len(coded.dictionary) + 1))
            by_scope = np.argsort(of_row, kind="stable")
            self.of_scope = {name: by_scope[edges[i] : edges[i + 1]] for i, name in enumerate(coded.dictionary.to_pylist())}
        self.units = {
            length: (place[unit.any(1)], unit[unit.any(1)])
            for length, (place, unit) in _by_length(rows["vector"].combine_chunks()).items()
            if unit.any()
        }
        self.groups: dict[tuple[int, str], tuple[_Group | None, np.ndarray]] = {}
        self.compared = 0

    def _group(self, length: int, scope: str) -> tuple[_Group | None, np.ndarray]:
        """The vectors of a length in a scope, and the first k of the others
        there, which score 0. Of equal vectors the first k ids are enough."""
        if (length, scope) not in self.groups:
            rows = self.of_scope.get(scope, np.empty(0, np.int64)) if scope else np.arange(len(self.ids))
            group = None
            flat = rows
            if length in self.units:
                place, unit = self.units[length]
                own = np.isin(place, rows)
                place, unit = place[own], unit[own]
                flat = np.setdiff1d(rows, place)
                if len(place):
                    order = np.argsort(self.rank[place], kind="stable")
                    place, unit = place[order], unit[order] + 0.0
                    same = np.unique(unit.view(f"V{8 * length}").ravel(), return_inverse=True)[1].ravel()
                    order = np.argsort(same, kind="stable")
                    same = same[order]
                    kept = np.sort(order[np.arange(len(same)) - np.searchsorted(same, same) < self.k])
                    group = _Group(place[kept], unit[kept])
            self.groups[length, scope] = group, flat[np.argsort(self.rank[flat], kind="stable")[: self.k]]
        return self.groups[length, scope]

    def _compare(self, best: _Best, group: _Group) -> None:
        small, unit = best.unit.astype("float32"), best.unit
        reach = group.reach(unit)
        sizes = np.diff(group.bounds)
        near = np.argsort(-reach, axis=1, kind="stable")
        before = np.cumsum(sizes[near], axis=1) - sizes[near]
        seed = np.zeros(reach.shape, bool)  # the nearest pivots that have k rows
        np.put_along_axis(seed, near, before < self.k, axis=1)
        for first in (True, False):
            wanted = seed if first else ~seed & (reach >= best.kth[:, None])
            if not first and (wanted @ sizes).sum() > DENSE * len(unit) * len(group.unit):
                # few are spared: all rows in blocks, but those that were compared
                of_row = np.repeat(np.arange(len(sizes)), sizes)
                block = max(1, SCORES // len(unit))
                for at in range(0, len(group.unit), block):
                    self.compared += len(unit) * len(group.unit[at : at + block])
                    scores = small @ group.small[at : at + block].T
                    query, row = np.divmod(np.flatnonzero(scores >= (best.kth - group.slack).astype("float32")[:, None]), scores.shape[1])
                    new = ~seed[query, of_row[at + row]]
                    best.meet(group, query[new], at + row[new])
                    best.settle()
                break
            for cell in np.flatnonzero(wanted.any(0)).tolist():
                query = np.flatnonzero(wanted[:, cell])
                a, b = group.bounds[cell : cell + 2]
                for at in range(a, b, max(1, SCORES // len(query))):
                    block = group.small[at : min(b, at + max(1, SCORES // len(query)))]
                    self.compared += len(query) * len(block)
                    scores = small[query] @ block.T
                    if first:
                        row, col = _candidates(scores.T, self.k, 2 * group.slack)
                    else:
                        col, row = np.nonzero(scores >= (best.kth[query] - group.slack).astype("float32")[:, None])
                    best.meet(group, query[col], at + row)
            best.settle()

    def search(self, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        """query_id, id, score: the k best rows of the split for each query."""
        queries = queries.combine_chunks()
        scopes = np.array([s or "" for s in queries["scope"].to_pylist()] if self.scoped else [""] * len(queries), object)
        parts = []
        for length, (place, unit) in _by_length(queries["vector"].combine_chunks()).items():
            some = unit.any(1)
            parts.append((length, place[some], unit[some]))
        flat = np.setdiff1d(np.arange(len(queries)), np.concatenate([p for _, p, _ in parts]) if parts else [])
        parts.append((0, flat, np.zeros((len(flat), 1))))
        for length, place, unit in parts:
            for scope in sorted(set(scopes[place].tolist())):
                of_scope = np.flatnonzero(scopes[place] == scope)
                group, zeros = self._group(length, scope)
                for at in range(0, len(of_scope), QUERIES):
                    own = of_scope[at : at + QUERIES]
                    best = _Best(unit[own], self.k, self.floor, self.rank)
                    if group is not None:
                        self._compare(best, group)
                    # rows of other lengths and without a direction score 0
                    asking = np.flatnonzero(best.kth <= 0) if self.floor <= 0 else np.empty(0, np.int64)
                    if len(asking) and len(zeros):
                        best.offer(np.repeat(asking, len(zeros)), np.tile(zeros, len(asking)), np.zeros(len(asking) * len(zeros)))
                        best.settle()
                    if len(best.query):
                        names = queries["query_id"].take(pa.array(place[own][best.query]))
                        out = pa.table({"query_id": names, "id": self.ids.take(pa.array(best.row)), "score": best.score})
                        yield from out.combine_chunks().to_batches()


def _runs(table: pa.Table) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """The runs of equal (block, split, side) of a sorted table."""
    place = np.stack([table[name].to_numpy() for name in ("block", "split", "side")])
    edges = np.flatnonzero((np.diff(place, axis=1) != 0).any(0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), place.shape[1]], strict=True):
        yield tuple(place[:, a].tolist()), table.slice(a, b - a)


def _dealing(tasks: int, split: int) -> tuple[Column, Column]:
    """The numbers of splits and of blocks of queries, from ``n_base`` and
    ``splits``. Together they fill the tasks, with about as many copies of a
    query as of a base row, so neither side is sent to every task; a base too
    large for tasks to hold makes more splits."""
    few = F.least(F.lit(math.isqrt(max(1, tasks) - 1) + 1), F.ceil(F.col("n_base") / min(split, SMALL_SPLIT)))
    splits = F.greatest(few, F.ceil(F.col("n_base") / max(split, SPLIT)), F.lit(1)).cast("int")
    return splits, F.greatest(F.ceil(tasks / F.col("splits")), F.lit(1)).cast("int")


def _ranked_ids(base: DataFrame, queries: DataFrame, k: int, scoped: bool, min_score: float | None, split: int) -> DataFrame:
    """query_id, id, score: the best k of each split, from ``base`` (id, vector,
    scope) and ``queries`` (query_id, vector, scope)."""
    spark = base.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splits, blocks = _dealing(tasks, split)

    def dealt(rows: DataFrame) -> DataFrame:
        n = base.agg(F.count(F.lit(1))).scalar()
        return rows.withColumn("n_base", n).withColumn("splits", splits).withColumn("blocks", blocks)

    id_type, query_type = base.schema["id"].dataType, queries.schema["query_id"].dataType
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    asked = dealt(queries).select(
        own("blocks", "query_id", "vector").alias("block"),
        every("splits").alias("split"),
        F.lit(1).alias("side"),
        "query_id",
        F.lit(None).cast(id_type).alias("id"),
        "vector",
        "scope",
    )
    held = dealt(base).select(
        every("blocks").alias("block"),
        own("splits", "id").alias("split"),
        F.lit(0).alias("side"),
        F.lit(None).cast(query_type).alias("query_id"),
        "id",
        "vector",
        "scope",
    )

    def search(batches):
        at, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for (*place, side), rows in _runs(pa.Table.from_batches([batch])):
                if place != at:
                    at, waiting, held = place, [], None
                if side == 0:
                    waiting.append(rows)
                elif waiting:
                    held = held or _Split(pa.concat_tables(waiting), k, scoped, min_score)
                    yield from held.search(rows)

    schema = T.StructType(
        [T.StructField("query_id", query_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())]
    )
    met = asked.unionByName(held).repartition(tasks, "block", "split").sortWithinPartitions("block", "split", "side")
    return met.mapInArrow(search, schema)


def nearest(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "log_id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    scope_col: str | None = None,
    min_score: float | None = None,
    split: int = SPLIT,
) -> DataFrame:
    """The k most similar base rows of each query, exactly.

    Result: ``query_id``, the base columns without the vector, ``score`` and
    ``rank`` (ties by id). With ``scope_col``, a query that has a value in that
    column of its own only sees base rows with the same value; a null or empty
    value sees all. ``min_score`` drops weaker hits before ranking. Ids of the
    base are unique and not null. Null and empty vectors, and vectors of
    unequal length, score 0.

    Nothing runs while the plan is built and no query passes the driver. A
    query is sent once per split and a base row once per block of queries. There
    are about as many splits as blocks, of ``split`` rows at least while that is
    few, and more once a split would have more than 65,536 rows (or ``split``,
    where that is more), which a task holds.
    Rows round a pivot are left out for a query when the triangle inequality on
    angles shows that none can reach the k-th best score found so far.
    """
    scope = F.col(scope_col) if scope_col else F.lit(None)
    # as they are stored, where that is half as long
    kinds = {base.schema[vector_col].dataType.simpleString(), queries.schema[query_vector].dataType.simpleString()}
    numbers = "array<float>" if kinds == {"array<float>"} else "array<double>"
    found = _ranked_ids(
        base.select(F.col(id_col).alias("id"), F.col(vector_col).cast(numbers).alias("vector"), scope.cast("string").alias("scope")),
        queries.select(
            F.col(query_id).alias("query_id"), F.col(query_vector).cast(numbers).alias("vector"), scope.cast("string").alias("scope")
        ),
        k,
        scope_col is not None,
        min_score,
        split,
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    payload = [name for name in base.columns if name != vector_col]
    joined = ranked.withColumnRenamed("id", "__id").join(base.select(payload), F.col("__id") == F.col(id_col))
    return joined.select("query_id", *payload, "score", "rank")


def top_k(
    base: DataFrame,
    query_vector: list[float],
    limit: int = 10,
    id_col: str = "log_id",
    vector_col: str = "vector",
    min_score: float | None = None,
) -> DataFrame:
    """The ``limit`` rows most similar to one vector, best first; ties by id.
    Each partition passes on its own best rows."""
    check_limit(limit)
    wanted = _by_length(pa.array([[float(x) for x in query_vector]], pa.list_(pa.float64())))
    kept = [field for field in base.schema.fields if field.name != vector_col]

    def best_of_partition(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = _cosines(batch.column(vector_col), wanted, 1)
            if min_score is not None:
                scores[scores < min_score] = -np.inf
            row, _ = _candidates(scores, limit)
            found = pa.Table.from_batches([batch]).drop_columns([vector_col]).take(pa.array(row))
            found = found.append_column("score", pa.array(scores[row, 0]))
            best = found if best is None else pa.concat_tables([best, found])
            order = np.lexsort((best[id_col].to_numpy(), -best["score"].to_numpy()))
            best = best.take(pa.array(order[:limit]))
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = base.mapInArrow(best_of_partition, T.StructType([*kept, T.StructField("score", T.DoubleType())]))
    return found.orderBy(F.desc("score"), id_col).limit(limit)


def scoped(
    base: DataFrame, service_id: str, environment: str | None = None, severity: str | None = None
) -> DataFrame:
    """Restrict a search to one service, which is required and must be well
    formed; plain filters, so the scan prunes the service's partition."""
    import re

    candidate = (service_id or "").strip()
    if not re.fullmatch(SERVICE_ID_PATTERN.replace(r"\z", ""), candidate):
        raise ValueError(
            "service_id is required and must contain only letters, numbers, '.', '_', ':', or '-'"
        )
    narrowed = base.filter(F.col("service_id") == candidate)
    if environment:
        narrowed = narrowed.filter(F.col("environment") == environment)
    if severity:
        narrowed = narrowed.filter(F.col("level") == severity.upper())
    return narrowed


def optionally_scoped(base: DataFrame, service_id: str | None = None) -> DataFrame:
    """A blank service searches everything. Missing fields get their display
    defaults."""
    if service_id and service_id.strip():
        base = base.filter(F.col("service_id") == service_id.strip())
    return base.withColumns(
        {
            "message": F.coalesce("message", F.lit("")),
            "level": F.coalesce("level", F.lit("UNKNOWN")),
            "service_id": F.coalesce("service_id", F.lit(UNKNOWN_SERVICE)),
        }
    )


def upsert_points(current: DataFrame | None, incoming: DataFrame, id_col: str = "log_id", version: str = "ts") -> DataFrame:
    """Latest row per id; incoming rows without a valid service are left out
    (:func:`rejected_points` has those). An incoming row wins over a stored one."""
    valid = incoming.withColumn("service_id", valid_service_id(F.col("service_id"))).filter("service_id is not null")
    merged = valid.withColumn("__fresh", F.lit(1))
    if current is not None:
        merged = merged.unionByName(current.withColumn("__fresh", F.lit(0)))
    columns = [name for name in merged.columns if name != "__fresh"]
    return (
        merged.groupBy(F.col(id_col).alias("__id"))
        .agg(F.max_by(F.struct(*columns), F.struct("__fresh", version)).alias("__row"))
        .select("__row.*")
    )


def rejected_points(incoming: DataFrame) -> DataFrame:
    return incoming.filter(valid_service_id(F.col("service_id")).isNull()).withColumn(
        "error", F.lit("log payload must include a valid service_id")
    )


def stored_payload(parsed: DataFrame) -> DataFrame:
    """The payload written directly from a parsed log: upper-case level, the
    service from the metadata's service or service.name."""
    return parsed.withColumns(
        {
            "level": F.upper(F.coalesce("level", F.lit("INFO"))),
            "message": F.coalesce("message", F.lit("")),
            "service_id": F.coalesce(
                F.nullif(F.try_element_at("metadata_kv", F.lit("service")), F.lit("")),
                F.nullif(F.try_element_at("metadata_kv", F.lit("service.name")), F.lit("")),
                F.lit(UNKNOWN_SERVICE),
            ),
        }
    )


def context_line(timestamp: Column, level: Column, message: Column, raw: Column) -> Column:
    """``- [ts] LEVEL: message (Raw: raw)``; missing values print as None."""
    show = [F.coalesce(column.cast("string"), F.lit("None")) for column in (timestamp, level, message, raw)]
    return F.format_string("- [%s] %s: %s (Raw: %s)", *show)


def answer_context(hits: DataFrame, *by: str) -> DataFrame:
    """Ranked hits (``rank`` and the line fields) to one text per query, or one
    text in all. At most k rows meet per query."""
    line = context_line(F.col("timestamp"), F.col("level"), F.col("message"), F.col("raw"))
    return hits.groupBy(*by).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda e: e["line"]), "\n"
        ).alias("log_context")
    )
