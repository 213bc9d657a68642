"""Alert rules, matching, deduplication, deliveries and payloads."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from timberflow.session import stored

# Window, channels and the chat colours.
DEDUP_SECONDS = 300
CHANNELS = ("email", "slack", "webhook", "log", "pagerduty")
SEVERITIES = ("info", "warning", "critical", "fatal")
CHAT_COLOURS = {
    "info": "#36a64f",
    "warning": "#ff9900",
    "critical": "#ff0000",
    "fatal": "#8b0000",
}
OTHER_COLOUR = "#808080"

# Time of the last firing where there was none, before every time.
NEVER = -(1 << 63)

# Entries of jump tables in one batch of a Python worker.
TABLE_ENTRIES = 1 << 20


@dataclass(frozen=True)
class AlertRule:
    """A rule; ``condition`` is a SQL predicate over the event columns and
    defaults to equality with the rule's severity."""

    id: str
    name: str
    description: str = ""
    severity: str = "critical"
    condition: str | None = None
    enabled: bool = True
    channels: tuple[str, ...] = ("log",)
    tags: tuple[str, ...] = field(default=())


RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)


def rules_frame(spark: SparkSession, rules: list[AlertRule]) -> DataFrame:
    rows = [(r.id, r.name, r.description, r.severity, r.enabled, list(r.channels), list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def register_rules(rules: DataFrame, new_rules: DataFrame) -> DataFrame:
    """Add rules. An id that exists already keeps its old row; see
    :func:`rejected_rules` for those."""
    fresh = new_rules.join(rules, "id", "left_anti").dropDuplicates(["id"])
    return rules.unionByName(fresh)


def rejected_rules(rules: DataFrame, new_rules: DataFrame) -> DataFrame:
    return new_rules.join(rules, "id", "left_semi").withColumn(
        "error", F.format_string("Alert rule with ID '%s' already exists", F.col("id"))
    )


def unregister_rules(rules: DataFrame, *ids: str) -> DataFrame:
    return rules.filter(~F.col("id").isin(*ids))


def set_enabled(rules: DataFrame, enabled: bool, *ids: str) -> DataFrame:
    return rules.withColumn(
        "enabled", F.when(F.col("id").isin(*ids), F.lit(enabled)).otherwise(F.col("enabled"))
    )


def get_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    return rules.filter(F.col("id") == rule_id)


def _keyed(matches: DataFrame) -> DataFrame:
    return matches.withColumn("deduplication_key", F.concat_ws(":", "rule_id", "service_id", "level"))


def match_rules(events: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """One row per (event, matching enabled rule), rules with predicates.

    The predicates become one array expression on the event row, so there is
    no join at all. A null predicate is no match; write casts as ``try_cast``
    so that an unreadable value ends there too.
    """
    enabled = [rule for rule in rules if rule.enabled]
    candidates = []
    for rule in enabled:
        holds = F.expr(rule.condition) if rule.condition else F.col("severity") == rule.severity
        candidates.append(
            F.when(
                holds,
                F.struct(
                    F.lit(rule.id).alias("rule_id"),
                    F.array(*[F.lit(channel) for channel in rule.channels]).alias("channels"),
                ),
            )
        )
    if not candidates:
        candidates = [F.lit(None).cast("struct<rule_id:string,channels:array<string>>")]
    fired = events.withColumn("__rule", F.explode(F.array_compact(F.array(*candidates))))
    return _keyed(fired.select(*events.columns, "__rule.rule_id", "__rule.channels"))


def match_rule_table(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Like :func:`match_rules` for a rule table, whose rules test severity.

    An equi-join on severity: the rule side is a small dimension, and the
    engine broadcasts it when its size allows.
    """
    active = rules.filter("enabled").select(F.col("id").alias("rule_id"), "severity", "channels")
    return _keyed(events.join(active, "severity"))


def deduplicate_alerts(
    matches: DataFrame,
    window_seconds: int = DEDUP_SECONDS,
    key: str = "deduplication_key",
    ts: str = "ts",
    tie: str = "log_id",
    windows_per_slice: int = 12,
    fan: int = 64,
) -> DataFrame:
    """Keep the alerts that fire: the first of a key, then each one at least
    ``window_seconds`` after the last that fired.

    Each decision depends on the one before, but two starting points soon lead
    to the same firing times. So every (key, time slice) computes, on its own, a
    jump table: the firing it would end on for each possible start, which is at
    most one entry per instant of one window, however full the slice is. Tables
    of ``fan`` slices compose into one of the same bound, twice, so what is left
    in order per key is one table for each ``fan * fan`` slices of time (170 days
    at the defaults). The starts then go down the same tree, and every slice
    marks its firings. Composing and handing down stream through sorted
    partitions: a task holds two tables at a time and never a whole key.

    A row without key or time never fires.
    """
    width = window_seconds * 1_000_000
    slice_width = width * windows_per_slice
    columns = matches.columns
    # Of several matches at one instant only the first can fire.
    instants = (
        matches.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
        .filter(F.col(key).isNotNull() & F.col("__at").isNotNull())
        .groupBy(F.col(key).alias("__key"), "__at")
        .agg(F.min_by(F.struct(*columns), tie).alias("__alert"))
        .withColumn("__slice", F.floor(F.col("__at") / slice_width))
    )
    times = instants.select("__key", "__slice", "__at")
    key_type = matches.schema[key].dataType.simpleString()
    table = f"__key {key_type}, __slice bigint, entries array<bigint>, ends array<bigint>"
    carry = f"__key {key_type}, __slice bigint, carry bigint"

    def in_order(rows: DataFrame, step: int | None, by: str) -> DataFrame:
        """``rows`` sorted by ``by`` within groups of ``step`` slices, without
        ``step`` within keys."""
        grouped = rows.withColumn("__group", F.floor(F.col("__slice") / step) if step else F.lit(0).cast("bigint"))
        return grouped.repartition("__key", "__group").sortWithinPartitions("__key", "__group", by)

    def composed(tables: DataFrame, step: int) -> DataFrame:
        return in_order(tables, step, "__slice").mapInPandas(
            lambda batches: _composed(batches, width, slice_width), table
        )

    def handed_down(tables: DataFrame, carries: DataFrame | None, step: int | None) -> DataFrame:
        """The last firing before each table. The start of a group is a row of
        its own ahead of the group's tables."""
        rows = tables.withColumns({"carry": F.lit(NEVER), "__order": F.col("__slice")})
        if carries is not None:
            heads = carries.withColumn("__order", F.lit(NEVER))
            rows = rows.unionByName(heads, allowMissingColumns=True)
        return in_order(rows, step, "__order").mapInPandas(lambda batches: _handed_down(batches, width), carry)

    # Written once: both ways of the tree read them.
    tables = stored(
        in_order(times, 1, "__at").mapInPandas(
            lambda batches: _jump_tables(batches, width, slice_width, windows_per_slice), table
        ),
        "alert-jumps",
    )
    middle = composed(tables, fan)
    top = composed(middle, fan * fan)
    carries = handed_down(top, None, None)
    carries = handed_down(middle, carries, fan * fan)
    carries = handed_down(tables, carries, fan)
    heads = carries.withColumn("__at", F.lit(NEVER))
    fired = in_order(times.withColumn("carry", F.lit(NEVER)).unionByName(heads), 1, "__at").mapInPandas(
        lambda batches: _firings(batches, width), f"__key {key_type}, __at bigint"
    )
    return instants.join(fired, ["__key", "__at"], "left_semi").select("__alert.*")


def _runs(batches):
    """Groups (``__key``, ``__group``) of sorted batches, each whole."""
    import numpy as np
    import pandas as pd

    rest = None
    for frame in batches:
        if rest is not None and len(rest):
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        keys, groups = frame["__key"].to_numpy(), frame["__group"].to_numpy()
        cuts = np.flatnonzero((groups[1:] != groups[:-1]) | (keys[1:] != keys[:-1])) + 1
        bounds = [0, *cuts.tolist()]
        for start, stop in zip(bounds[:-1], bounds[1:]):
            yield frame.iloc[start:stop]
        rest = frame.iloc[bounds[-1]:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _last_of_runs(entries, ends):
    """Of neighbouring entries with one end only the last is needed."""
    import numpy as np

    keep = np.append(ends[1:] != ends[:-1], True)
    return entries[keep], ends[keep]


def _jump_tables(batches, width, slice_width, windows):
    """Jump table of every slice: a start ``width`` after the last firing goes
    to the first entry at or after it, and from there to that entry's end."""
    import numpy as np
    import pandas as pd

    names = ["__key", "__slice", "entries", "ends"]
    rows, held = [], 0
    for frame in _runs(batches):
        at, slot = frame["__at"].to_numpy(), frame["__slice"].iloc[0]
        # Starts from an earlier slice can only enter in the first window.
        last = np.arange(min(int(np.searchsorted(at, slot * slice_width + width)) + 1, len(at)))
        entries = at[last]
        for _ in range(windows):
            following = np.searchsorted(at, at[last] + width)
            last = np.where(following < len(at), following, last)
        entries, ends = _last_of_runs(entries, at[last])
        rows.append((frame["__key"].iloc[0], slot, entries, ends))
        held += len(entries)
        if held >= TABLE_ENTRIES or len(rows) >= 5000:
            yield pd.DataFrame(rows, columns=names)
            rows, held = [], 0
    yield pd.DataFrame(rows, columns=names)


def _composed(batches, width, slice_width):
    """One jump table per group, under the group's first slice."""
    import numpy as np
    import pandas as pd

    names = ["__key", "__slice", "entries", "ends"]
    group, slot, entries, ends = None, None, None, None
    for frame in batches:
        rows = []
        for key, part, first, more, targets in zip(
            frame["__key"], frame["__group"], frame["__slice"], frame["entries"], frame["ends"]
        ):
            more, targets = np.asarray(more), np.asarray(targets)
            if group != (key, part):
                if group is not None:
                    rows.append((group[0], slot, entries, ends))
                group, slot, entries, ends = (key, part), first, more, targets
                continue
            place = np.searchsorted(more, ends + width)
            ends = np.where(place < len(more), targets[np.minimum(place, len(more) - 1)], ends)
            # A start that passes every entry so far is still within the first
            # window, hence before this table.
            if entries[-1] < slot * slice_width + width:
                entries, ends = np.append(entries, more[0]), np.append(ends, targets[0])
            entries, ends = _last_of_runs(entries, ends)
        yield pd.DataFrame(rows, columns=names)
    if group is not None:
        yield pd.DataFrame([(group[0], slot, entries, ends)], columns=names)


def _handed_down(batches, width):
    import numpy as np
    import pandas as pd

    group, last = None, None
    for frame in batches:
        rows = []
        columns = ("__key", "__group", "__slice", "__order", "entries", "ends", "carry")
        for key, part, slot, order, entries, ends, carry in zip(*(frame[name] for name in columns)):
            if group != (key, part):
                group, last = (key, part), NEVER
            if order == NEVER:
                last = int(carry)
                continue
            rows.append((key, slot, last))
            place = int(np.searchsorted(np.asarray(entries), last + width))
            if place < len(ends):
                last = int(ends[place])
        yield pd.DataFrame(rows, columns=["__key", "__slice", "carry"])


def _firings(batches, width):
    import numpy as np
    import pandas as pd

    pending, size = [], 0
    for frame in _runs(batches):
        # The first row is the head with the last firing before.
        carry, at = int(frame["carry"].iloc[0]), frame["__at"].to_numpy()[1:]
        place = int(np.searchsorted(at, carry + width))
        fired = []
        while place < len(at):
            fired.append(at[place])
            place = int(np.searchsorted(at, at[place] + width))
        if fired:
            pending.append(pd.DataFrame({"__key": [frame["__key"].iloc[0]] * len(fired), "__at": fired}))
            size += len(fired)
        if size >= 10_000:
            yield pd.concat(pending, ignore_index=True)
            pending, size = [], 0
    if pending:
        yield pd.concat(pending, ignore_index=True)


def alert_history(
    alerts: DataFrame, limit: int = 100, rule_id: str | None = None, service_id: str | None = None, ts: str = "ts", tie: str = "log_id"
) -> DataFrame:
    """The last ``limit`` alerts in firing order, optionally of one rule or
    service."""
    if rule_id:
        alerts = alerts.filter(F.col("rule_id") == rule_id)
    if service_id:
        alerts = alerts.filter(F.col("service_id") == service_id)
    newest = alerts.orderBy(F.desc(ts), F.desc(tie), F.desc("rule_id")).limit(limit)
    return newest.orderBy(ts, tie, "rule_id")


def alert_deliveries(alerts: DataFrame, handled: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per alert and channel; ``handled`` are the channels that have a
    handler, others are skipped."""
    return alerts.withColumn("channel", F.explode("channels")).filter(F.col("channel").isin(*handled))


def _iso(ts: Column) -> Column:
    stamp = ts.cast("timestamp")
    return F.when(
        F.pmod(F.unix_micros(stamp), F.lit(1_000_000)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    ).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def chat_payload(ts: Column) -> Column:
    """JSON text of the chat message for an alert row."""
    colour = F.lit(OTHER_COLOUR)
    for severity, value in CHAT_COLOURS.items():
        colour = F.when(F.col("severity") == severity, value).otherwise(colour)

    def entry(title: str, value: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short"))

    attachment = F.struct(
        colour.alias("color"),
        F.col("rule_id").alias("title"),
        F.col("message").alias("text"),
        F.array(
            entry("Severity", F.col("severity")),
            entry("Service", F.col("service_id")),
            entry("Anomaly Score", F.col("anomaly_score").cast("string")),
            entry("Timestamp", _iso(ts)),
        ).alias("fields"),
    )
    return F.to_json(
        F.struct(F.concat(F.lit("Alert: "), F.col("rule_id")).alias("text"), F.array(attachment).alias("attachments"))
    )


def webhook_payload(ts: Column) -> Column:
    """JSON text of the webhook notification for an alert row."""
    event = F.struct(
        "service_id", "level", "message", "anomaly_score", "severity", _iso(ts).alias("timestamp")
    )
    return F.to_json(
        F.struct(
            "rule_id",
            event.alias("event"),
            _iso(ts).alias("triggered_at"),
            "channels",
            "deduplication_key",
        )
    )


def alert_health(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: status, number of rules and of alerts."""
    return (
        rules.agg(F.count("*").alias("rules_count"))
        .withColumn("alert_history_count", alerts.agg(F.count("*")).scalar())
        .withColumn("status", F.lit("healthy"))
    )
