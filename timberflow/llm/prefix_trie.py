"""Prefix trie of conversations by truncation peeling.

Every conversation becomes the chain of digests of its first 1, 2, ... turns. From
the greatest depth up, the conversations that end at a depth meet the nodes
that survive from below it; grouping by the chain digest makes the nodes of
that depth with all their sums, the last turn is stripped off and the rest goes
up by one. All sums are combined before the shuffle, so a first turn that a
third of the corpus shares costs one row per task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from timberflow.session import stored, workspace

RUN_BITS = 12  # ids of up to 4096 neighbouring values are joined before they are hashed
HOT_SHARE = 1000  # parents with more than this part of all nodes as children: fewer than as many
WORD = r"[^\x20\x09-\x0D]+"
TAIL_SHARE, TAIL_TURNS = 10, 1 << 17  # the deepest turns that are peeled in one round: one in so many, and at most
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NOTHING = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text: the turns of each conversation
    by turn number, null first; ties by role, then text. A null role or text
    counts as empty, rows of a null conv_id belong to no conversation and are
    left out, repeated rows are turns of their own, other columns are not read."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    return rows.withColumn("position", place).drop("turn")


def digested(turns: DataFrame) -> DataFrame:
    """``turns`` with a digest of role and text, and the words of the text, in
    place of these."""
    body = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    return turns.select(
        "conv_id",
        "position",
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )


def with_heads(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that begin as the first one of their block: the first h
    turns of conversation c - c % block (as in SQL, towards 0), then the own
    turns after the first h; h is the unsigned crc32 of the decimal id modulo
    ``heads``. One row per conversation, without turns too: conv_id, turns
    (array of digest, words). ``turns`` has conv_id, position, digest, words."""
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    step = lambda part: F.struct(F.lit(part).alias("part"), "position", "digest", "words")
    mine = turns.select("conv_id", F.lit(True).alias("own"), F.when(F.col("position") > share, step(1)).alias("step"))
    first = turns.filter((F.col("conv_id") % block == 0) & (F.col("position") < heads))
    reach = F.sequence(F.lit(1 - block), F.lit(block - 1))
    lent = (
        first.withColumnRenamed("conv_id", "first")
        .withColumn("conv_id", F.explode(F.transform(reach, lambda k: F.try_add(F.col("first"), k.cast("bigint")))))
        .filter((F.col("conv_id") - F.col("conv_id") % block == F.col("first")) & (F.col("position") <= share))
        .select("conv_id", F.lit(False).alias("own"), step(0).alias("step"))
    )
    return (
        mine.unionAll(lent)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("step")).alias("steps"), F.max("own").alias("own"))
        .filter("own")
        .select("conv_id", F.transform("steps", lambda s: F.struct(s["digest"], s["words"])).alias("turns"))
    )


def _chains(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, path: for each depth the digest of all turns up to it
    and the words of its last turn; the root is the digest of nothing."""

    def longer(path: Column, turn: Column) -> Column:
        key = F.unhex(F.sha2(F.concat(F.element_at(path, -1)["key"], turn["digest"]), 256))
        return F.concat(path, F.array(F.struct(key.alias("key"), turn["words"].alias("words"))))

    root = F.array(F.struct(F.unhex(F.lit(NOTHING)).alias("key"), F.lit(0).cast("bigint").alias("words")))
    path = F.aggregate("turns", root, longer)
    return conversations.select("conv_id", F.size("turns").alias("depth"), path.alias("path"))


def _ends(chains: DataFrame) -> DataFrame:
    """key, ends_sha256: digest of the ids of the conversations that end at a
    node, in ascending order. Runs of neighbouring ids are joined first; a task
    then hashes the runs of its nodes one after the other and holds one."""
    runs = (
        chains.select(F.element_at("path", -1)["key"].alias("key"), "conv_id", F.shiftright("conv_id", RUN_BITS).alias("run"))
        .groupBy("key", "run")
        .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )

    def digest(batches):
        key, state = None, None
        for batch in batches:
            found: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _pairs(found)
        if key is not None:
            yield _pairs([(key, state.hexdigest())])

    ordered = runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids")
    return ordered.mapInArrow(digest, "key binary, ends_sha256 string")


def _pairs(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["key", "ends_sha256"])


def _tail_start(chains: DataFrame) -> tuple[int, int]:
    """Greatest depth (-1 without conversations), and the depth below which the
    turns are so few that one task can hold them: no more than one in
    ``TAIL_SHARE`` of all and ``TAIL_TURNS``."""
    ending = {r["depth"]: r["count"] for r in chains.groupBy("depth").count().collect()}  # a row per length
    room = min(TAIL_TURNS, sum(d * n for d, n in ending.items()) // TAIL_SHARE)
    deepest = start = max(ending, default=-1)
    longer = 0  # conversations with more than ``start`` turns
    while start > 0 and longer + ending.get(start, 0) <= room:
        longer += ending.get(start, 0)
        room -= longer
        start -= 1
    return deepest, start


def _peel_tail(rows: DataFrame, start: int) -> DataFrame:
    """Nodes below depth ``start`` from the few conversations that reach them,
    peeled within the groups that share their first turns. ``path`` is kept at
    the first of these depths, where the others go on."""

    def peel(group: pa.Table) -> pa.Table:
        ended: dict[int, list] = {}
        for conv, path in zip(group["conv_id"].to_pylist(), group["path"].to_pylist(), strict=True):
            ended.setdefault(len(path) - 1, []).append((path, [conv, 1, 0, 0, 0]))
        out, survivors = [], []
        for depth in range(max(ended), start, -1):
            nodes: dict[bytes, tuple[list, list]] = {}
            for path, counts in ended.get(depth, []) + survivors:
                known = nodes.setdefault(path[depth]["key"], (path, [counts[0], 0, 0, 0, 0]))[1]
                known[0] = min(known[0], counts[0])
                known[1:] = [a + b for a, b in zip(known[1:], counts[1:], strict=True)]
            survivors = []
            for key, (path, counts) in nodes.items():
                counts[3] = max(counts[3], 1)
                counts[4] += (counts[1] - 1) * path[depth]["words"]
                last = path[: depth + 1] if depth == start + 1 else None
                out.append(dict(zip(fields, (key, last, *counts, path[depth - 1]["key"], depth), strict=True)))
                survivors.append((path, [counts[0], counts[1], 1, *counts[3:]]))
        return pa.Table.from_pylist(out, types)

    fields = ["key", "path", "conv_id", *COUNTS, "parent", "depth"]
    step = pa.struct([("key", pa.binary()), ("words", pa.int64())])
    types = pa.schema(
        [("key", pa.binary()), ("path", pa.list_(step)), *[(c, pa.int64()) for c in fields[2:7]], ("parent", pa.binary()), ("depth", pa.int32())]
    )
    schema = f"{PEELED}, depth int"
    top = F.element_at("path", start + 2)["key"].alias("top")
    return rows.select(top, "conv_id", "path").groupBy("top").applyInArrow(lambda group: peel(group.select(["conv_id", "path"])), schema)


PEELED = f"key binary, path array<struct<key:binary,words:bigint>>, conv_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, parent binary"


def _peel(chains: DataFrame) -> DataFrame:
    """All nodes: depth, key, parent, conv_id and the counts. A round per depth
    writes its nodes to the shared folder, where the next one takes them up."""
    spark = chains.sparkSession
    deepest, start = _tail_start(chains)
    folder = workspace(spark, "trie")
    lowest = F.element_at("path", -1)
    below = None
    if deepest > start:
        tail = _peel_tail(chains.filter(F.col("depth") > start), start)
        tail.write.partitionBy("depth").parquet(folder)
        below = start + 1
    for depth in range(start, -1, -1):
        rows = chains.filter(F.col("depth") == depth).select(
            "path", "conv_id", F.lit(1).cast("bigint").alias("n_convs"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTS[1:]]
        )
        if below is not None:
            survivors = spark.read.schema(PEELED).parquet(f"{folder}/depth={below}")
            one = F.lit(1).cast("bigint").alias("n_children")
            rows = rows.unionAll(survivors.select(F.slice("path", 1, below).alias("path"), "conv_id", "n_convs", one, *COUNTS[2:]))
        nodes = (
            rows.groupBy(lowest["key"].alias("key"))
            .agg(F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in COUNTS])
            .withColumns(
                {
                    "n_leaves": F.greatest("n_leaves", F.lit(1)),
                    "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * lowest["words"],
                    "parent": F.try_element_at("path", F.lit(-2))["key"],
                }
            )
        )
        nodes.write.parquet(f"{folder}/depth={depth}")
        below = depth
    fields = f"{PEELED}, depth int"
    return spark.read.schema(fields).parquet(folder) if below is not None else spark.createDataFrame([], fields)


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the conv_id of their parent. Parents of very many nodes,
    fewer than ``HOT_SHARE`` by their definition, are sent to all tasks."""
    total = nodes.count()
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.filter(F.col("n_children") * HOT_SHARE > total).drop("n_children"))
    rest = parents.filter(F.col("n_children").between(1, total // HOT_SHARE)).drop("n_children")
    below = nodes.filter("depth > 0")
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    near = below.join(hot, "parent")
    far = below.join(hot.select("parent"), "parent", "left_anti").join(rest, "parent")
    return root.unionByName(near).unionByName(far)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id without
    repeats, turns: array of digest, words): conv_id (smallest member), depth,
    parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A conversation without turns (null or empty array) ends at the root; no
    conversations give no rows. Conversations with equal turns share all their
    nodes. There is a round per depth, but for the deepest, which few
    conversations reach: these are peeled in one round. One task chains the
    turns of one conversation.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull())
    turns = F.coalesce("turns", F.expr("cast(array() as array<struct<digest:binary,words:bigint>>)"))
    chains = _chains(rows.withColumn("turns", turns)).repartitionByRange("depth", "conv_id")
    chains = stored(chains, "chains", "depth")
    nodes = stored(_with_parents(_peel(chains).drop("path")), "trie-nodes")
    return nodes.join(_ends(chains), "key", "left").select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        *COUNTS,
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
