import json
import random
import tempfile

from pyspark.sql import functions as F

from timberflow.sources import files as FI, otlp as OT, queue as QU, records as RE, sinks as SK


def payload_frame(spark, *values):
    rows = [(str(n), v if isinstance(v, str) else json.dumps(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "record_id string, value string")


def one_record(record, resource=None):
    return {"resourceLogs": [{"resource": {"attributes": resource or []}, "scopeLogs": [{"logRecords": [record]}]}]}


def text(key, value):
    return {"key": key, "value": {"stringValue": value}}


def test_otlp_record_overrides_resource(spark):
    record = {
        "timeUnixNano": "1682124012000000000",
        "severityNumber": 17,
        "severityText": "ERROR",
        "body": {"stringValue": "Database connection failed"},
        "attributes": [text("db.system", "postgresql"), text("env", "staging")],
    }
    resource = [text("service.name", "auth-service"), text("env", "production")]
    row = OT.flatten_payloads(payload_frame(spark, one_record(record, resource))).first()
    assert (row.level, row.message, row.parser_type) == ("ERROR", "Database connection failed", "otlp_log")
    assert row.timestamp == "2023-04-22T00:40:12Z" and row.raw == row.message
    assert row.metadata_kv == {"service.name": "auth-service", "env": "staging", "db.system": "postgresql", "service": "auth-service"}


def test_otlp_bodies_and_odd_parts(spark):
    bodies = [
        {"stringValue": "[2026-05-16 10:30:00] ERROR: payment-service failed"},
        {"boolValue": True},
        {"intValue": "42"},
        {"doubleValue": 2.5},
        {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "7"}, {"arrayValue": {"values": [{"boolValue": False}]}}]}},
        "plain",
    ]
    payload = {
        "resourceLogs": [
            "skip",
            {"scopeLogs": "not a list"},
            {"scopeLogs": [{"logRecords": [{"body": body, "attributes": {"not": "a list"}} for body in bodies] + [3, None]}]},
            {"resource": 5, "scopeLogs": [{"logRecords": [{"severityNumber": "22"}]}]},
        ]
    }
    rows = OT.flatten_payloads(payload_frame(spark, payload, "broken {", {"other": 1}), F.lit("NOW")).collect()
    messages = [r.message for r in rows]
    assert messages == ["payment-service failed", "True", "42", "2.5", '["a",7,[false]]', "plain", ""]
    assert rows[0].parser_type == "standard" and rows[0].metadata_kv["service"] == "payment-service"
    assert rows[0].timestamp == "2026-05-16T10:30:00" and rows[1].timestamp == "NOW"
    assert rows[6].level == "FATAL" and rows[1].level == "INFO"


def test_otlp_to_canonical_rows_redacts(spark):
    record = {"body": {"stringValue": "User test@example.com logged in"}, "severityText": "INFO"}
    df = OT.otlp_logs(payload_frame(spark, one_record(record, [text("service.name", "gateway"), text("owner", "x@y.io")])), F.lit("2026-01-01T00:00:00Z"))
    row = RE.accepted(df).first()
    assert row.message == row.raw == "User [REDACTED:EMAIL] logged in"
    assert row.service_id == "gateway" and row.metadata_kv["owner"] == "[REDACTED:EMAIL]" and row.redactions == {"EMAIL": 1}


def test_batch_partial_success(spark):
    good = {"timestamp": "2026-05-20T10:00:00Z", "level": "INFO", "message": "valid log entry a@b.io", "service_id": "test-service"}
    blank = dict(good, message="")
    unnamed = {"message": "x", "extra": 1}
    df = payload_frame(spark, {"logs": [good, blank, unnamed]}, {"logs": [good]}, {"logs": []})
    rows = {r.batch_id: r for r in RE.batch_report(RE.structured_records(RE.batch_records(df))).collect()}
    assert (rows["0"].status, rows["0"].processed_records, rows["0"].failed_records) == ("partial_success", 1, 2)
    assert [(f.record_index, f.error) for f in rows["0"].failures] == [(1, RE.EMPTY_MESSAGE), (2, RE.BAD_SERVICE)]
    assert rows["1"].status == "success" and rows["1"].redaction_summary == {"EMAIL": 1} and rows["1"].failures == []
    assert [r.record_id for r in RE.batch_errors(df).collect()] == ["2"]


def test_batch_report_reads_its_records_once(spark):
    good = {"message": "a@b.io c@d.io", "service_id": "s"}
    df = payload_frame(spark, {"logs": [good, {"message": "x"}, good]})
    report = RE.batch_report(RE.structured_records(RE.batch_records(df)))
    row = report.first()
    assert (row.processed_records, row.failed_records, row.redaction_summary) == (2, 1, {"EMAIL": 4})
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1


def test_structured_extras_and_defaults(spark):
    df = payload_frame(spark, {"message": "m", "metadata": {"service.name": "meta-svc", "k": {"deep": 1}}, "region": "eu", "host": "h1"})
    row = RE.accepted(RE.structured_records(df)).first()
    assert row.service_id == row.service == "meta-svc" and row.level == "INFO" and row.timestamp is None
    assert row.metadata_kv["region"] == "eu" and row.metadata_kv["host"] == "h1" and row.metadata_kv["service_id"] == "meta-svc"
    assert json.loads(row.metadata_kv["k"]) == {"deep": 1}


def test_raw_line_request_metadata_wins(spark):
    df = spark.createDataFrame(
        [("1", "[2026-05-16 10:30:00] ERROR: auth-service failed", "svc-req", {"team": "core"}), ("2", " ", None, None), ("3", "x", "bad id", None)],
        "record_id string, value string, sid string, md map<string,string>",
    )
    rows = RE.raw_lines(df, "sid", "md").orderBy("record_id").collect()
    # The line's own service word is looked at before the request's metadata.
    assert rows[0].service_id == "auth-service" and rows[0].metadata_kv["service"] == "svc-req"
    assert rows[0].metadata_kv["team"] == "core" and rows[0].service == "svc-req"
    assert rows[1].reject_reason == RE.EMPTY_MESSAGE and rows[2].reject_reason == "service_id is malformed"


def test_queue_round_trip_and_dead_letters(spark):
    df = payload_frame(spark, {"message": "disk full", "service": "svc-a", "level": "error"})
    messages = QU.queue_payload(RE.accepted(RE.structured_records(df)))
    row = QU.payload_logs(QU.classify_payloads(messages)).first()
    assert (row.message, row.level, row.service_id, row.parser_type) == ("disk full", "ERROR", "svc-a", "structured_input")
    assert row.semantic_text.startswith("level=ERROR service=svc-a disk full {")
    bad = payload_frame(spark, "{ this is not json", "", "  ", "[1]", '{"invalid": "payload"}', '{"parsed": "text"}')
    got = [r.outcome for r in QU.classify_payloads(bad).orderBy("record_id").collect()]
    assert got == ["failed_logs"] + ["malformed_payloads"] * 5


def test_file_readers_batch_and_stream(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/a.log", "w") as out:
        out.write('{"timestamp": "2026-01-02T03:04:05Z", "level": "WARN", "service_id": "sim", "message": "hot"}\nnot json\n')
    with open(f"{folder}/skip.txt", "w") as out:
        out.write("ignored\n")
    parsed = FI.json_lines(FI.read_lines(spark, folder, pattern="*.log"))
    rows = parsed.orderBy("body").collect()
    assert [(r.body, r.severity) for r in rows] == [("hot", "warn"), ("not json", None)]
    record = RE.structured_records(FI.collected_records(parsed).withColumn("record_id", F.col("body")))
    first = RE.accepted(record).filter("message = 'hot'").first()
    assert first.service_id == "sim" and first.level == "WARN" and first.timestamp == "2026-01-02T03:04:05+00:00"
    stream = FI.json_lines(FI.read_lines(spark, folder, streaming=True, pattern="*.log"))
    query = stream.select("body").writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.body for r in spark.table("tail").collect()) == ["hot", "not json"]


def test_syslog_lines(spark):
    lines = ["Jan  2 03:04:05 web1 sshd[77]: Failed password", "Feb 12 10:00:00 web2 kernel: all fine", "no syslog"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(lines)], "n int, value string")
    rows = FI.syslog_lines(df, 2026).orderBy("n").collect()
    assert str(rows[0].ts) == "2026-01-02 03:04:05" and rows[0].attributes == {"hostname": "web1", "service": "sshd", "pid": "77"}
    assert rows[0].severity == "error" and rows[0].body == "Failed password"
    assert rows[1].attributes["service"] == "kernel" and rows[1].severity is None
    assert rows[2].ts is None and rows[2].body == "no syslog"


def test_sinks_are_repeatable(spark):
    root = tempfile.mkdtemp(prefix="run-")
    logs = spark.createDataFrame([("1", "a", "2026-01-01 00:00:00"), ("2", "b", "2026-01-09 00:00:00"), ("2", "b", "2026-01-09 00:00:00")], "log_id string, service_id string, t string")
    logs = logs.withColumn("ts", F.to_timestamp("t"))
    for _ in range(2):
        SK.write_new_logs(logs, f"{root}/logs", salt_files=2)
    assert SK.read_table(spark, f"{root}/logs").count() == 2
    SK.write_archive(logs, f"{root}/archive")
    archive = SK.read_table(spark, f"{root}/archive")
    assert archive.count() == 3
    now = F.to_timestamp(F.lit("2026-01-10 00:00:00"))
    assert {r.log_id for r in SK.retained(archive, now).collect()} == {"2"}
    assert [str(r.day) for r in SK.expired_days(archive, now).collect()] == ["2026-01-01"]
    incidents = spark.createDataFrame([("i1", "because"), ("i2", " ")], "incident_id string, explanation string")
    for _ in range(2):
        SK.write_incidents(incidents, f"{root}/incidents")
    assert SK.read_table(spark, f"{root}/incidents").count() == 1
    assert SK.latest_snapshot(spark, f"{root}/none") is None
    SK.write_snapshot(incidents, f"{root}/snap", 0)
    SK.write_snapshot(incidents.limit(1), f"{root}/snap", 1)
    assert SK.latest_snapshot(spark, f"{root}/snap").count() == 1
    assert SK.latest_snapshot(spark, f"{root}/snap", before=1).count() == 2


CLUSTER_COLUMNS = (
    "cluster_id string, representative_log string, occurrence_count bigint, first_seen bigint, last_seen bigint, "
    "sample_logs array<string>, similarity_score_average double, service_name string, score_first double, "
    "score_sum double, vector array<double>"
)


def cluster_rows(spark, version, numbers):
    rows = [
        (f"c{n}", f"log {n}", 1 + version, version, version + 1, [f"sample {n} {version}"], 0.5, "svc", 0.5, 0.5 * version, [float(n), float(version)])
        for n in numbers
    ]
    return spark.createDataFrame(rows, CLUSTER_COLUMNS)


def as_rows(df):
    """Stored rows without the two columns that only a batch's share uses."""
    names = [c.split()[0] for c in CLUSTER_COLUMNS.split(", ")]
    return sorted(tuple(map(str, r)) for r in df.select([n for n in names if n not in ("score_first", "score_sum")]).collect())


def test_cluster_deltas_equal_the_full_merge(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/clusters"
    want, states = None, {}
    batches = [range(40), [3, 5, 41], [], [5], [3, 41, 42]]
    for version, numbers in enumerate(batches):
        batch = cluster_rows(spark, version, numbers)
        for _ in range(2):  # a repeated batch replaces what it wrote
            SK.upsert_clusters(batch, path, version)
        if numbers:
            want = SK.merged_clusters(want, batch)
            assert spark.read.parquet(SK.delta_path(path, version)).count() == len(numbers)
        states[version] = as_rows(want)
        assert as_rows(SK.latest_snapshot(spark, path)) == states[version]
        if version == 1:
            for _ in range(2):
                SK.compact_clusters(spark, path, version)
            assert as_rows(SK.latest_snapshot(spark, path)) == states[version]
    # Older versions can still be read, and a repeated old batch starts there.
    assert as_rows(SK.latest_snapshot(spark, path, before=1)) == states[0]
    assert as_rows(SK.latest_snapshot(spark, path, before=4)) == states[3]


def test_removed_clusters_and_compaction(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/clusters"
    SK.remove_clusters(cluster_rows(spark, 0, [1]), path, 0)
    SK.compact_clusters(spark, path, 0)
    assert SK.latest_snapshot(spark, path) is None
    SK.upsert_clusters(cluster_rows(spark, 1, [1, 2, 3]), path, 1)
    SK.remove_clusters(spark.createDataFrame([("c2",), ("unknown",)], "cluster_id string"), path, 2)
    assert {r.cluster_id for r in SK.latest_snapshot(spark, path).collect()} == {"c1", "c3"}
    SK.compact_clusters(spark, path, 2)
    SK.upsert_clusters(cluster_rows(spark, 3, [2]), path, 3)
    back = {r.cluster_id: r.occurrence_count for r in SK.latest_snapshot(spark, path).collect()}
    assert back == {"c1": 2, "c2": 4, "c3": 2}
    assert SK.superseded(spark, path) == []
    SK.compact_clusters(spark, path, 3)
    assert [p.rsplit("/", 1)[1][-1] for p in SK.superseded(spark, path)] == ["1", "2"]
    SK.remove_clusters(cluster_rows(spark, 0, [1, 2, 3]), path, 4)
    SK.compact_clusters(spark, path, 4)
    assert SK.latest_snapshot(spark, path).count() == 0
    SK.upsert_clusters(cluster_rows(spark, 5, [7]), path, 5)
    assert {r.cluster_id for r in SK.latest_snapshot(spark, path).collect()} == {"c7"}


def test_upsert_reads_touched_buckets_only(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/clusters"
    SK.upsert_clusters(cluster_rows(spark, 0, range(300)), path, 0)
    SK.compact_clusters(spark, path, 0)
    SK.upsert_clusters(cluster_rows(spark, 1, range(300)), path, 1)
    plan = SK.latest_snapshot(spark, path, buckets=[5])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [isnotnull(bucket" in line and "= 5)" in line for line in scans)
    got = {r.cluster_id for r in SK.latest_snapshot(spark, path, buckets=[5]).collect()}
    every = cluster_rows(spark, 0, range(300)).withColumn("b", F.pmod(F.xxhash64("cluster_id"), F.lit(SK.CLUSTER_BUCKETS)))
    assert got and got == {r.cluster_id for r in every.filter("b = 5").collect()}


def any_value(value):
    """The wire form of a plain value."""
    if isinstance(value, bool):
        return {"boolValue": value}
    if isinstance(value, int):
        return {"intValue": str(value)}
    if isinstance(value, float):
        return {"doubleValue": value}
    if isinstance(value, str):
        return {"stringValue": value}
    if isinstance(value, list):
        return {"arrayValue": {"values": [any_value(v) for v in value]}}
    if isinstance(value, dict):
        return {"kvlistValue": {"values": [{"key": k, "value": any_value(v)} for k, v in value.items()]}}
    return {}


def nested(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([7, -1, True, "a\"\\\n\x00\x01é", "", 2.5, "x,y", 123456789012345678])
    if rng.random() < 0.5:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {f"k{n}\t": nested(rng, depth - 1) for n in range(rng.randrange(3))}


def test_otlp_values_of_any_depth(spark):
    rng = random.Random(5)
    values = [[nested(rng, 6)] for _ in range(150)] + [[[[[[[[1]]]]]]], {"a": {"b": {"c": {"d": [{}]}}}}]
    # the last of equal keys wins, and marks in a plain text are just text
    rows = [
        json.dumps(one_record({"body": any_value(v), "attributes": [text("v", "\x00[1]\x01"), {"key": "w", "value": any_value(v)}, text("w", "x"), {"key": "w", "value": any_value([v])}]}))
        for v in values
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "record_id int, value string")
    got = {int(r.record_id.split("/")[0]): r for r in OT.flatten_payloads(df).collect()}
    plain = lambda v: json.loads(json.dumps(v))
    for n, value in enumerate(values):
        assert json.loads(got[n].raw) == plain(value)
        assert json.loads(got[n].metadata_kv["w"]) == plain([value]) and got[n].metadata_kv["v"] == "\x00[1]\x01"


def test_otlp_deep_values_equal_shallow_ones(spark):
    """What Python decodes far down reads as what expressions decode on top."""
    numbers = ["1", " 12 ", "+5", "1.5", "x", "9223372036854775808", "", "1e5", "0.0001", "-12345678.25", "1e300", "0", "-0.0", "100", "9999999.5", "0.001"]
    odd = [{kind: n} for kind in ("intValue", "doubleValue") for n in numbers]
    odd += [{kind: n} for kind in ("intValue", "doubleValue") for n in (3, 2.5, 1e22, 1e-7, True, [1], {"a": 1})]
    odd += [{"stringValue": v} for v in (None, 5, "\x1f\x7f ", ["a"])] + [{"boolValue": v} for v in (None, "x", False)]
    odd += [{"arrayValue": v} for v in (None, {}, {"values": None}, {"values": 3}, [{"intValue": 1}], {"values": [None, 3, "s"]})]
    odd += [{"kvlistValue": v} for v in (None, {}, {"values": 3}, {"values": [3]}, {"values": [None]}, {"values": [{"key": None, "value": {}}, {"key": "k"}, {"value": {"intValue": 1}}]}, [{"key": 5, "value": {"boolValue": True}}])]
    odd += [None, 3, 2.50, "s", True, {}, {"b": 1, "a": [1.0, None]}, [1, {"z": 1}]]
    wrapped = [{"arrayValue": {"values": [{"arrayValue": {"values": [{"arrayValue": {"values": [v]}}]}}]}} for v in odd]
    frame = spark.createDataFrame([(n, json.dumps(a), json.dumps(b)) for n, (a, b) in enumerate(zip(odd, wrapped))], "n int, a string, b string")
    deep = F.get(OT.decode_marked(F.array(OT.any_value_json(F.parse_json("b")))), F.lit(0))
    for r in frame.select("n", OT.any_value_json(F.parse_json("a"), 3).alias("a"), deep.alias("b")).collect():
        assert r.b == f"[[[{r.a}]]]", (odd[r.n], r.a, r.b)
