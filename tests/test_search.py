"""The search over query tables, next to a plain loop."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from timberflow.operators.search import _dealing, _Split, nearest, top_k
from timberflow.sources.records import batch_errors, batch_records


def cosine(a, b):
    a, b = [x or 0.0 for x in a or []], [x or 0.0 for x in b or []]
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if len(a) == len(b) and norm else 0.0


def expected(base, queries, k, scoped=False, least=None):
    out = {}
    for name, vector, scope in queries:
        hits = [
            (-round(cosine(vector, v), 9), i)
            for i, v, s in base
            if (not scoped or not scope or s == scope) and (least is None or cosine(vector, v) >= least)
        ]
        for rank, (score, i) in enumerate(sorted(hits)[:k], 1):
            out[name, rank] = (i, -score)
    return out


def found(rows):
    return {(r["query_id"], r["rank"]): (r["log_id"], round(r["score"], 9)) for r in rows.collect()}


def vectors(n, seed):
    return [[((i * 37 + j * seed) % 19 - 9) / 4 for j in range(3 + (i % 7 == 0))] for i in range(n)]


def test_nearest_equals_loop(spark):
    base = [(i, v, f"s{i % 3}") for i, v in enumerate(vectors(60, 5))]
    base += [(100, None, "s0"), (101, [], "s1"), (102, [0.0, 0.0, 0.0], None), (103, [None, 1.0, 2.0], "s2")]
    queries = [(f"q{i}", v, ["s1", "", None][i % 3]) for i, v in enumerate(vectors(23, 11))] + [("none", None, None), ("few", [1.0], "s2")]
    logs = spark.createDataFrame(base, "log_id int, vector array<double>, service_id string").withColumn("text", F.col("log_id").cast("string"))
    asked = spark.createDataFrame(queries, "query_id string, query_vector array<double>, service_id string")
    for split in (4, 4096):
        hits = nearest(logs, asked.drop("service_id"), 4, split=split)
        assert hits.columns == ["query_id", "log_id", "service_id", "text", "score", "rank"]
        assert found(hits) == expected(base, queries, 4)
        scoped = nearest(logs, asked, 3, scope_col="service_id", min_score=0.2, split=split)
        assert found(scoped) == expected(base, queries, 3, True, 0.2)


def held(vectors, ids, k, scopes=None, least=None):
    rows = pa.table({"id": ids, "vector": pa.array(vectors, pa.list_(pa.float64())), "scope": pa.array(scopes or [None] * len(ids), pa.string())})
    return _Split(rows, k, scopes is not None, least)


def asked(split, vectors, scopes=None):
    n = len(vectors)
    rows = {"query_id": range(n), "vector": pa.array(vectors, pa.list_(pa.float64())), "scope": pa.array(scopes or [None] * n, pa.string())}
    out = [r for b in split.search(pa.table(rows)) for r in b.to_pylist()]
    return {q: sorted((-round(r["score"], 9), r["id"]) for r in out if r["query_id"] == q) for q in range(n)}


def test_pivots_spare_most_pairs_of_clustered_vectors():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(60, 32))
    near = lambda n: (centres[draw.integers(0, 60, n)] + 0.05 * draw.normal(size=(n, 32))).tolist()
    base, queries = near(6000), near(300)
    split = held(base, list(range(6000)), 10)
    got = asked(split, queries)
    unit = lambda v: np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit(queries) @ unit(base).T
    for q in range(300):
        assert [i for _, i in got[q]] == np.lexsort((np.arange(6000), -scores[q].round(9)))[:10].tolist()
    assert 300 * 10 <= split.compared < 0.1 * 6000 * 300


def test_pivots_lose_nothing():
    """Ties, negative and zero scores, other lengths, scopes and thresholds."""
    draw = np.random.default_rng(4)
    kinds = [None, [], [0.0, 0.0, 0.0], [1.0], [None, 1.0, 2.0]]
    vectors = [draw.integers(-2, 3, 3).astype(float).tolist() for _ in range(400)] + kinds * 5
    scopes = [["a", "b", None][int(k)] for k in draw.integers(0, 3, len(vectors))]
    queries = [draw.integers(-2, 3, 3).astype(float).tolist() for _ in range(40)] + kinds
    wanted = [["a", "", None, "zz"][k % 4] for k in range(len(queries))]
    base = list(zip(range(len(vectors)), vectors, scopes, strict=True))
    for k, scoped, least in ((1, False, None), (7, True, None), (7, False, 0.3), (500, True, 0.0), (3, True, -0.5)):
        got = asked(held(vectors, list(range(len(vectors))), k, scopes if scoped else None, least), queries, wanted if scoped else None)
        want = expected(base, list(zip(range(len(queries)), queries, wanted, strict=True)), k, scoped, least)
        for q in range(len(queries)):
            # parallel vectors tie but for rounding: any of them may stand at the k-th place
            assert [-s for s, _ in got[q]] == [want[q, r][1] for r in range(1, k + 1) if (q, r) in want]
            for score, i in got[q]:
                assert abs(cosine(queries[q], vectors[i]) + score) < 1e-8 and (not scoped or not wanted[q] or scopes[i] == wanted[q])


def test_queries_meet_rows_of_their_scope_only():
    draw = np.random.default_rng(6)
    base, queries = draw.normal(size=(2000, 16)), draw.normal(size=(50, 16))
    scopes = ["abcde"[i % 5] for i in range(2000)]
    split = held(base.tolist(), list(range(2000)), 4, scopes)
    got = asked(split, queries.tolist(), ["c"] * 50)
    scores = queries @ base.T / np.linalg.norm(queries, axis=1)[:, None] / np.linalg.norm(base, axis=1)
    for q in range(50):
        own = scores[q, 2::5]
        assert [i for _, i in got[q]] == (2 + 5 * np.argsort(-own, kind="stable")[:4]).tolist()
    assert split.compared <= 1.1 * 50 * 400


def test_equal_vectors_are_compared_k_times():
    draw = np.random.default_rng(7)
    base = [[1.0, 2.0, 0.5]] * 3000 + draw.normal(size=(20, 3)).tolist()
    ids = draw.permutation(len(base)).tolist()
    split = held(base, ids, 3)
    got = asked(split, [[2.0, 4.0, 1.0]] * 40)
    assert all([i for _, i in got[q]] == sorted(ids[:3000])[:3] for q in range(40))
    assert split.compared <= 40 * 60


def test_neither_side_is_sent_to_every_task(spark):
    for n, tasks, split in ((615_000, 200, 1 << 16), (615_000, 200, 300), (50_000, 200, 300)):
        splits, blocks = _dealing(tasks, split)
        row = spark.createDataFrame([(n,)], "n_base long").withColumn("splits", splits).withColumn("blocks", blocks).first()
        assert row.splits <= 16 and row.blocks <= 20 and row.splits * row.blocks >= tasks and n / row.splits <= 1 << 16


def test_nearest_of_empty_tables(spark):
    logs = spark.createDataFrame([(1, [1.0])], "log_id int, vector array<double>")
    asked = spark.createDataFrame([("q", [1.0])], "query_id string, query_vector array<double>")
    assert nearest(logs.limit(0), asked, 2).count() == 0
    assert nearest(logs, asked.limit(0), 2).count() == 0


def test_nearest_runs_nothing_while_it_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    logs = spark.range(50).select(F.col("id").alias("log_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    asked = logs.toDF("query_id", "query_vector")
    spark.sparkContext.setJobGroup("building", "plan only")
    try:
        nearest(logs, asked, 2)
        assert len(tracker.getJobIdsForGroup("building")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_top_k_ties_and_lengths(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [1.0]), (5, [-1.0, 0.0])]
    logs = spark.createDataFrame(rows, "log_id int, vector array<double>")
    assert [(r.log_id, r.score) for r in top_k(logs, [1, 0], 4).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)]


def test_batches_of_any_size(spark):
    many = '{"logs": [' + ",".join('{"message": "m"}' for _ in range(1001)) + "]}"
    df = spark.createDataFrame([("a", many), ("b", '{"logs": []}')], "record_id string, value string")
    assert batch_records(df).count() == 1001
    assert [r.record_id for r in batch_errors(df).collect()] == ["b"]
