"""The skew-safe operators against one-by-one processing, with one hot key."""

import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from timberflow.operators import alerts as A, anomalies as N, clusters as C, metrics as M, sequences as S


def skewed_rows(seed, count, span_seconds):
    """(id, micros, key): two thirds of the rows have one key, times repeat."""
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        key = "hot" if rng.random() < 0.66 else f"k{rng.randrange(4)}"
        rows.append((n, 1_700_000_000_000_000 + rng.randrange(span_seconds * 4) * 250_000, key))
    return rows


def test_trailing_counts_and_scores_match_the_loop(spark):
    rows = skewed_rows(1, 3000, 4000)
    df = spark.createDataFrame([(n, us, k, "ERROR") for n, us, k in rows], "log_id int, us bigint, service_id string, level string")
    logs = df.withColumn("ts", F.timestamp_micros("us"))
    got = {r.log_id: (r.error_count, r.z_score) for r in N.scored_counts(N.error_counts(logs), history=50).collect()}
    active, history = {}, {}
    for n, us, key in sorted(rows, key=lambda r: (r[1], r[0])):
        active[key] = [t for t in active.get(key, []) if t > us - 300_000_000] + [us]
        past = history[key] = (history.get(key, []) + [len(active[key])])[-50:]
        spread = statistics.stdev(past) if len(past) > 1 else 0
        score = (past[-1] - statistics.mean(past)) / spread if spread else 0.0
        assert got[n][0] == len(active[key])
        assert abs(got[n][1] - score) < 1e-9
    again = N.scored_counts(N.error_counts(logs.repartition(1)), history=50)
    assert {r.log_id: r.error_count for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_small_blocks_give_the_same_frames(spark):
    df = spark.range(1, 501).select(F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") * 7 % 13).alias("v"))
    framed = S.moving_frame(df, "key", "seq", 10, {"total": F.sum("v")}, block=16)
    values = {r.seq: r.v for r in df.collect()}
    for row in framed.collect():
        assert row.total == sum(values[i] for i in range(max(1, row.seq - 9), row.seq + 1))


def test_running_offsets_two_levels(spark):
    df = spark.range(0, 300).select(F.lit("k").alias("key"), (F.col("id") * 3).alias("slot"), F.lit(2).alias("n"))
    rows = S.running_offsets(df, "key", "slot", "n", fan=10).orderBy("slot").collect()
    assert [r.offset for r in rows] == [2 * i for i in range(300)]


def test_alert_dedup_matches_the_loop(spark):
    for windows_per_slice in (1, 3, 12):
        rows = skewed_rows(2, 4000, 20_000)
        df = spark.createDataFrame(rows, "log_id int, us bigint, deduplication_key string").withColumn("ts", F.timestamp_micros("us"))
        got = A.deduplicate_alerts(df, 300, windows_per_slice=windows_per_slice)
        fired, last = set(), {}
        for n, us, key in sorted(rows, key=lambda r: (r[1], r[0])):
            if key not in last or us - last[key] >= 300_000_000:
                last[key] = us
                fired.add(n)
        assert {r.log_id for r in got.collect()} == fired


def test_alert_dedup_across_long_gaps(spark):
    seconds = [0, 10, 290, 301, 5000, 5299, 5300, 5601, 100_000, 100_299, 100_300]
    df = spark.createDataFrame([(n, "k", s) for n, s in enumerate(seconds)], "log_id int, deduplication_key string, s int")
    got = A.deduplicate_alerts(df.withColumn("ts", F.timestamp_seconds("s")), 300, windows_per_slice=2)
    assert sorted(r.s for r in got.collect()) == [0, 301, 5000, 5300, 5601, 100_000, 100_300]


def loop_dedup(at, width):
    fired, last = [], None
    for t in at:
        if last is None or t - last >= width:
            fired.append(t)
            last = t
    return fired


def test_alert_dedup_tree_of_every_shape(spark):
    rng = random.Random(11)
    for fan in (2, 3):
        want, rows = {}, []
        for key, span, count in (("dense", 400, 4000), ("sparse", 90_000, 60), ("mixed", 20_000, 900), ("one", 1, 1)):
            at = sorted({rng.randrange(-span, span) for _ in range(count)})
            rows += [(key, t) for t in at]
            want[key] = loop_dedup(at, 10)
        rows += [(None, 5), ("null", None)]
        df = spark.createDataFrame(rows, "deduplication_key string, s int").withColumns(
            {"ts": F.timestamp_seconds("s"), "log_id": F.col("s")}
        )
        got = {}
        for r in A.deduplicate_alerts(df, 10, windows_per_slice=1, fan=fan).collect():
            got.setdefault(r.deduplication_key, []).append(r.s)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_alert_dedup_tables_stay_within_a_window():
    """One event a millisecond, windows of a second: no table of the tree holds
    more entries than one window has instants, plus the first one after it."""
    import numpy as np
    import pandas as pd

    width, windows, fan = 1_000_000, 3, 4
    at = np.arange(0, 60_000_000, 1000)
    slots = at // (width * windows)
    frame = pd.DataFrame({"__key": "hot", "__group": slots, "__slice": slots, "__at": at})
    level = list(A._jump_tables(iter([frame[:7000], frame[7000:]]), width, width * windows, windows))
    while sum(map(len, level)) > 1:
        tables = pd.concat(level, ignore_index=True)
        assert tables["entries"].map(len).max() <= width // 1000 + 1
        for entries, ends in zip(tables["entries"], tables["ends"]):
            assert np.all(np.diff(entries) > 0) and np.all(np.diff(ends) != 0)
        tables["__group"] = np.arange(len(tables)) // fan
        level = list(A._composed(iter([tables[:3], tables[3:]]), width, width * windows))
    top = pd.concat(level, ignore_index=True)
    assert top["ends"][0][0] == loop_dedup(at.tolist(), width)[-1]


def test_percentiles_are_exact_with_heavy_ties(spark):
    rng = random.Random(3)
    values = [1.0] * 700 + [rng.random() * 100 for _ in range(1300)]
    rows = [("hot", v) for v in values] + [("one", 5.0)] + [("few", float(v)) for v in range(20)]
    df = spark.createDataFrame(rows, "operation string, latency_ms double")
    got = {r.operation: (r.p95, r.p99, r.p50) for r in S.ranked_values(df, "operation", "latency_ms", {"p95": 0.95, "p99": 0.99, "p50": 0.5}).collect()}
    for key in ("hot", "one", "few"):
        ordered = sorted(v for k, v in rows if k == key)
        assert got[key] == tuple(ordered[int(len(ordered) * p)] for p in (0.95, 0.99, 0.5))


def test_percentiles_read_their_input_once(spark):
    """The answer is read from the histogram alone, and keys or values that are
    null have a defined result."""
    rows = [(None, 3.0), (None, 1.0), ("a", None), ("a", 2.0), ("a", 2.0), ("a", -0.5), ("none", None)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "operation string, latency_ms double").repartition(3).mapInArrow(counted, "operation string, latency_ms double")
    got = S.ranked_values(df, "operation", "latency_ms", {"low": 0.0, "mid": 0.5, "top": 0.99})
    assert {tuple(r) for r in got.collect()} == {(None, 1.0, 3.0, 3.0), ("a", -0.5, 2.0, 2.0)}
    assert seen.value == len(rows)
    assert S.ranked_values(df.limit(0), "operation", "latency_ms", {"mid": 0.5}).count() == 0


def planted(spark, groups, copies, noise, width=32, seed=5):
    """``groups`` directions with ``copies`` near copies each (the first group
    has ten times as many), plus one equal vector per group."""
    rng = random.Random(seed)
    rows, truth, n = [], {}, 0
    for g in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(width)]
        for c in range(copies * (10 if g == 0 else 1)):
            vector = [x + rng.gauss(0, noise) for x in centre] if c != 1 else list(centre)
            rows.append((n, n, f"log {g}", vector))
            truth[n] = g
            n += 1
    order = list(range(n))
    rng.shuffle(order)
    rows = [(i, order[i], text, v) for i, _, text, v in rows]
    return spark.createDataFrame(rows, "log_id int, ts int, message string, vector array<double>"), truth


def check_clusters(df, truth, threshold, **options):
    rows = C.assign_clusters(df, threshold, **options).collect()
    by_cluster = {}
    for row in rows:
        by_cluster.setdefault(row.cluster_id, []).append(row)
    for members in by_cluster.values():
        assert len({truth[r.log_id] for r in members}) == 1
        assert sum(not r.is_duplicate for r in members) == 1
        assert all(r.similarity_score >= threshold for r in members if r.is_duplicate)
    assert len(rows) == len(truth)
    return by_cluster


def test_clusters_in_one_block_equal_the_loop(spark):
    df, truth = planted(spark, 12, 8, 0.05)
    found = check_clusters(df, truth, 0.92)
    assert len(found) == 12
    firsts = {}
    for row in df.collect():
        firsts[truth[row.log_id]] = min(firsts.get(truth[row.log_id], (10**9, 0)), (row.ts, row.log_id))
    for members in found.values():
        leader = next(r for r in members if not r.is_duplicate)
        assert firsts[truth[leader.log_id]] == (leader.ts, leader.log_id)


def test_clusters_with_hashing_and_crowded_buckets(spark):
    df, truth = planted(spark, 20, 6, 0.05)
    found = check_clusters(df, truth, 0.92, block=16)
    assert len(found) == 20


def test_unrelated_vectors_in_one_bucket_are_split(spark):
    """All in one bucket, none similar: further hash bits must end it."""
    rng = random.Random(9)
    rows = [(n, n, "m", [rng.gauss(0, 1) for _ in range(32)]) for n in range(120)]
    df = spark.createDataFrame(rows, "log_id int, ts int, message string, vector array<double>")
    out = C.assign_clusters(df, 0.92, block=32, tables=1, bits=0)
    assert out.filter("is_duplicate").count() == 0 and out.select("cluster_id").distinct().count() == 120


def test_blank_text_and_missing_vector_stay_out(spark):
    rows = [(1, 1, " ", [1.0, 0.0]), (2, 2, "a", []), (3, 3, "b", [1.0, 0.0]), (4, 4, "c", None)]
    df = spark.createDataFrame(rows, "log_id int, ts int, message string, vector array<double>")
    got = {r.log_id: r.cluster_id is None for r in C.assign_clusters(df).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_running_average_counts_the_first_score_twice(spark):
    rows = [(1, 1, "a", False, 0.0), (2, 2, "b", True, 0.95), (3, 3, "c", True, 0.99)]
    df = spark.createDataFrame(rows, "log_id int, ts int, message string, is_duplicate boolean, similarity_score double")
    df = df.withColumns({"cluster_id": F.lit("c1"), "service_id": F.lit("s")})
    average = 0.0
    for n, score in ((2, 0.95), (3, 0.99)):
        average = ((average or score) * (n - 1) + score) / n
    row = C.cluster_table(df).first()
    assert abs(row.similarity_score_average - average) < 1e-12
    assert row.sample_logs == ["c", "b", "a"]


def test_reduction_percentage(spark):
    df = spark.createDataFrame([(3, 10), (1, 10), (3, 0), (50, 10)], "n int, total int")
    got = [r[0] for r in df.select(C.reduction_percentage(F.col("n"), F.col("total"))).collect()]
    assert got == [20.0, 0.0, 0.0, 100.0]


def test_empty_latency_history(spark):
    empty = spark.createDataFrame([], "operation string, latency_ms double, batch_size int, success boolean")
    assert M.latency_metrics(empty).collect() == []


def leader_loop(rows, threshold):
    """log_id to (leader's id, score), one by one in order of arrival."""
    leaders, out = [], {}
    for log_id, _, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        unit = np.array(v) / np.linalg.norm(v)
        scores = np.array([u @ unit for _, u in leaders])
        if len(scores) and scores.max() >= threshold:
            out[log_id] = (leaders[int(scores.argmax())][0], round(float(scores.max()), 6))
        else:
            leaders.append((log_id, unit))
            out[log_id] = (log_id, 0.0)
    return out


def loose_rows():
    """Neighbours of neighbours, at all distances about the threshold."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(25, 24))
    vectors = centres[rng.integers(0, 25, 300)] + rng.normal(size=(300, 24)) * rng.choice([0.1, 0.25, 0.4], (300, 1))
    order = rng.permutation(300)
    return [(k, int(order[k]), "m", [float(x) for x in vectors[k]]) for k in range(300)]


def decided(df, **options):
    rows = C.assign_clusters(df, 0.92, **options).collect()
    first = {r.cluster_id: r.log_id for r in rows if not r.is_duplicate}
    return {r.log_id: (first[r.cluster_id], round(r.similarity_score, 6)) for r in rows}


def test_clusters_do_not_depend_on_the_block(spark):
    rows = loose_rows()
    df = spark.createDataFrame(rows, "log_id int, ts int, message string, vector array<double>")
    want = leader_loop(rows, 0.92)
    assert len({x for x, _ in want.values()}) < 290
    for block in (40, 2048):
        assert decided(df, block=block, bits=0) == want
    hashed = decided(df, block=40)
    assert hashed == decided(df, block=100) == decided(df, block=2048)
    assert sum(hashed[k] == want[k] for k in want) >= 0.95 * len(want)


def test_the_hashing_plan_keeps_the_recall_at_every_threshold():
    for threshold in (0.0, 0.4, 0.8, 0.92, 0.99, 1.0):
        tables, bits = C.hashing_plan(threshold)
        agree = 1 - np.arccos(threshold) / np.pi
        assert bits >= 1 and 1 - (1 - agree**bits) ** tables >= 0.95


def test_comparing_buckets_copies_rows_a_bounded_number_of_times():
    """600,000 vectors in 16 buckets of each table: a bucket is three pieces,
    not nineteen, and a task reads about 128 MB."""
    import inspect

    block = inspect.signature(C.assign_clusters).parameters["block"].default
    assert 600_000 / 2**4 / block <= 3
    tasks = C._tasks(600_000, 64, 18, 4, block, 12)
    assert 600_000 * 64 * 4 * 18 * 3 / tasks <= 130 << 20
    assert C._tasks(2000, 64, 18, 4, block, 12) is None


def test_vectors_are_not_sent_with_every_key_to_find_its_bucket(spark):
    rows = [(f"i{k}", k, k, [1.0, float(k)], [k % 2, 0]) for k in range(6)]
    df = spark.createDataFrame(rows, "item string, at long, id long, vec array<float>, sigs array<long>")
    told = C._look_back(df, df.filter("at < 0"), 0.9, 4, True)
    lines = told._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [lines[i + 1] for i, line in enumerate(lines) if "posexplode(" in line]
    assert below and not any("vec#" in line for line in below)


def test_packed_vectors_are_read_back_exactly(spark):
    rng = np.random.default_rng(3)
    counts = (rng.poisson(0.7, 31) / np.float32(7.3)).astype("float32")
    rows = [[float(x) for x in counts], [1.0, None, -2.5], [0.1] * 40, [float(x) for x in rng.normal(size=300)], [1e300, 0.0], [0.5], [float(k % 60) for k in range(500)]]
    for kind in ("double", "float"):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(rows) if kind == "double" or k != 4], f"n int, vec array<{kind}>")
        got = df.coalesce(1).select("n", "vec", C._packed(F.col("vec")).alias("packed")).toArrow()
        back = C._unpacked(got["packed"].combine_chunks())
        for v, read in zip(got["vec"].to_pylist(), back, strict=True):
            want = np.array([np.nan if x is None else x for x in v])
            assert np.array_equal(read[: len(v)], want, equal_nan=True) and not read[len(v) :].any()
    few = spark.createDataFrame([([float(x) for x in counts[:16]] * 16,)], "vec array<float>")
    assert len(few.select(C._packed(F.col("vec"))).first()[0]) < 256


def test_vectors_without_a_similar_one_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    alone = rng.normal(size=(400, 48))
    vectors = np.concatenate([alone, alone[:40] + rng.normal(size=(40, 48)) * 0.05])
    order = rng.permutation(len(vectors))
    rows = [(k, int(order[k]), "m", [float(x) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "log_id int, ts int, message string, vector array<double>")
    want = decided(df, block=2048)
    sent, look_back = [], C._look_back

    def counted(active, leaders, *rest):
        sent.append(active.count() + (leaders.count() if leaders is not None else 0))
        return look_back(active, leaders, *rest)

    monkeypatch.setattr(C, "_look_back", counted)
    assert decided(df, block=32) == want
    assert 400 <= len({x for x, _ in want.values()}) < 410
    # the first phase sees all of its rows, then only the 80 with a similar one go on
    assert sum(sent) < 440 + 100, sent


def test_documents_are_embedded_once(spark, tmp_path, monkeypatch):
    from timberflow.operators import embedding as E
    from timberflow.plans import cluster_plans as P

    texts = [f"job {k % 6} failed" for k in range(12)] + [" ", "", None, "  a b c"]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    embedded, embedder = spark.sparkContext.accumulator(0), E.hashing_embedder

    def counting(dimensions):
        def seen(batches):
            for batch in batches:
                embedded.add(batch.num_rows)
                yield batch

        return lambda df, text, vector: embedder(dimensions)(df.mapInArrow(seen, df.schema), text, vector)

    monkeypatch.setattr(E, "hashing_embedder", counting)
    got = {r.log_id: (r.cluster_id, r.is_duplicate) for r in P.semantic_clusters(spark, str(tmp_path)).collect()}
    assert embedded.value == len({t or "" for t in texts})
    assert [got[k][0] for k in (12, 13, 14)] == [None] * 3 and got[15][0] and not got[15][1]
    assert all(got[k][0] == got[k + 6][0] and got[k + 6][1] for k in range(6))
