import json

from pyspark.sql import functions as F

from timberflow.operators import parsing as P


def parsed_rows(df):
    return P.parse_lines(df).orderBy("n").collect()


def test_strict_lines(lines):
    rows = parsed_rows(
        lines(
            "[2026-05-16 10:30:00] ERROR: auth-service failed",
            "[2026-05-16T14:24:49Z] INFO: deployment completed",
            "this is not a valid log format",
            "",
            '{"timestamp":"2026","level":"INFO",',
            '\n {\n"timestamp": "2026-05-16T10:30:00Z", "level": "error",\n "message": "payment-service timeout", "request_id": "abc123", "deep": {"a": [1]}}\n ',
            '{"level": "TRACE", "message": "trace event", "timestamp": "1716746096"}',
            '{"level": "WARNING", "message": "x"}',
            "[invalid-timestamp] INFO: timestamp failure",
            "{not json}",
            '{"timestamp": 12, "message": "typed"}',
            "[2026-05-16 10:30:00] warning: lower case",
            "[2026-05-16 10:30:00] FATAL: unknown here",
            '{"message": "see (billing-Service), then", "service": "explicit"}',
        )
    )
    kinds = [r.parser_type for r in rows]
    assert kinds == [
        "standard", "standard", None, None, None, "structured_json", "structured_json", "structured_json",
        "standard", "fallback_json", "fallback_json", "standard", None, "structured_json",
    ]
    assert rows[0].level == "ERROR" and rows[0].message == "auth-service failed"
    assert rows[0].timestamp == "2026-05-16T10:30:00"
    assert rows[0].metadata_kv == {"service": "auth-service"}
    assert rows[1].timestamp == "2026-05-16T14:24:49+00:00"
    assert rows[5].level == "ERROR"
    assert rows[5].metadata_kv["request_id"] == "abc123"
    assert rows[5].metadata_kv["service"] == "payment-service"
    assert rows[6].level == "INFO" and rows[6].timestamp == "2024-05-26T17:54:56+00:00"
    assert rows[7].level == "WARN" and rows[7].timestamp is None
    assert rows[8].timestamp == "invalid-timestamp" and rows[8].timestamp_failed
    assert rows[9].level == "INFO" and rows[9].message == "{not json}" and rows[9].timestamp == ""
    assert rows[9].is_malformed_json and not rows[10].is_malformed_json
    assert rows[11].level == "WARN"
    assert rows[13].metadata_kv == {"service": "billing-Service"}


def test_nested_metadata_survives(lines):
    df = P.parse_lines(lines('{"message": "m-service", "deep": {"a": [1, "x"]}, "n": 5}'))
    text = df.select(F.to_json("metadata")).first()[0]
    assert json.loads(text) == {"deep": {"a": [1, "x"]}, "n": 5, "service": "m-service"}


def test_parser_metrics(lines):
    df = lines("[2026-05-16 10:30:00] INFO: a", "bad", "", '{"message": "j"}', "{broken}", "[nope] INFO: t")
    row = P.parser_metrics(P.parse_lines(df)).first().asDict()
    assert row == {
        "parsed_logs": 4,
        "failed_logs": 3,
        "structured_json_logs": 1,
        "standard_logs": 3,
        "timestamp_failures": 1,
        "empty_logs": 1,
    }


MULTI = [
    ('{"level": "warn", "message": "m", "a": 1}', "json", 1.0, "WARN", "m"),
    ('10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 200 23 "http://r" "Moz"', "apache_combined", 0.75, "INFO", None),
    ("Jan 12 06:25:01 host1 sshd[55]: accepted", "syslog", 0.75, "INFO", None),
    ("2026-05-16T10:30:00.123Z [error] svc it broke", "iso8601_structured", 0.75, "ERROR", "it broke"),
    ("2026-05-16T10:30:00.123Z info kubelet default/pod-1 started", "kubernetes", 0.75, "INFO", None),
    ("2026/05/16 10:30:00 [debug] hello", "generic_timestamp_level", 0.5, "DEBUG", "hello"),
    ("connection reset user=5 code=7", "key_value", 0.5, "INFO", "connection reset"),
    ("{broken", "key_value", 0.5, "INFO", "{broken"),
    ("{broken}", "json", 0.5, "INFO", "{broken}"),
    ("user=5", "key_value", 0.5, "INFO", "user=5"),
    (" a=1 b=2", "plain_text", 0.5, "INFO", " a=1 b=2"),
    ("   ", None, 0.0, None, None),
]


def test_multi_format_winners(lines):
    df = P.parse_multi_format(lines(*[case[0] for case in MULTI])).orderBy("n")
    for row, (text, name, coverage, level, message) in zip(df.collect(), MULTI):
        assert (row.parser_used, row.coverage, row.level) == (name, coverage, level), text
        if name:
            assert row.message == (text if message is None else message)
            assert row.success
        else:
            assert not row.success and row.error_message == "Empty log line"


def test_multi_format_metadata_and_captured_time(lines):
    row = P.parse_multi_format(lines("Jan 12 06:25:01 host1 sshd: accepted")).first()
    assert row.metadata_kv == {"hostname": "host1", "process": "sshd", "pid": None}
    assert row.timestamp is None and row.captured_timestamp == "Jan 12 06:25:01"


def test_custom_format_wins_at_full_coverage(lines):
    custom = P.custom_format(
        "pipes", r"^(\S+)\|(\w+)\|(\w+)\|(.*)$", ("timestamp", "level", "shard", "message"), True, True, True
    )
    df = lines("2026-01-01|warn|s1|disk full", "no pipes here")
    rows = P.parse_multi_format(df, custom=(custom,)).orderBy("n").collect()
    assert (rows[0].parser_used, rows[0].coverage, rows[0].level, rows[0].message) == ("pipes", 1.0, "WARN", "disk full")
    assert rows[0].timestamp == "2026-01-01" and rows[0].metadata_kv == {"shard": "s1"}
    assert rows[1].parser_used == "key_value"
    stats = P.parse_statistics(P.parse_multi_format(df, custom=(custom,))).first()
    assert (stats.total_attempted, stats.successfully_parsed, stats.partially_parsed, stats.failed) == (2, 1, 1, 0)
    counts = {r["name"]: r["matches"] for r in P.format_coverage(P.parse_multi_format(df, custom=(custom,)), custom=(custom,)).collect()}
    assert counts["pipes"] == 1 and counts["plain_text"] == 1 and counts["key_value"] == 1


def test_suggestion_needs_five_lines_and_seventy_percent(lines):
    syslog = ["Jan 12 06:25:01 host1 cron: tick"] * 4
    assert P.suggest_format(lines(*syslog)).collect() == []
    # Every line also fits the catch-all formats; the first in list order wins a tie.
    row = P.suggest_format(lines(*syslog, *syslog)).first()
    assert row.suggested_pattern == "syslog"
    row = P.suggest_format(lines(*syslog, "x", "y")).first()
    assert row.suggested_pattern == "key_value"


def test_batch_report_and_health(lines):
    parsed = P.parse_multi_format(lines('{"message": "a"}', "plain", ""))
    report = P.batch_report(parsed).first()
    assert report.total_lines == 3 and report.successfully_parsed == 2 and report.failed_to_parse == 1
    assert report.parser_usage == {"json": 1, "key_value": 1}
    assert P.parser_health(P.parse_statistics(parsed)).first().status == "degraded"
    sample = P.sample_analysis(P.parse_multi_format(lines("x" * 150))).first()
    assert len(sample.line) == 100


def test_probe_pattern(lines):
    rows = P.probe_pattern(lines("a=1", "zzz"), r"(\w)=(\d)", ("key", "num")).orderBy("n").collect()
    assert rows[0].matches and rows[0].groups == {"key": "a", "num": "1"} and rows[0].groups_count == 2
    assert not rows[1].matches and rows[1].groups is None
