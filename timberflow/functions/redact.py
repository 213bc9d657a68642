"""Secret and personal-data rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from timberflow.functions.text import let, rewrite_matches


@dataclass(frozen=True)
class Rule:
    """One redaction rule.

    ``triggers`` are literals of which any match must contain at least one
    (empty: none known). Testing for them is far cheaper than running the
    expression, and most log lines contain none. No match is shorter than
    ``least`` bytes, and ``hint`` is a cheaper expression that is found in every
    match. ``luhn`` keeps matches whose digits fail the card checksum.
    """

    label: str
    pattern: str
    triggers: tuple[str, ...] = ()
    fold_case: bool = False
    luhn: bool = False
    least: int = 0
    hint: str | None = None

    @property
    def token(self) -> str:
        return f"[REDACTED:{self.label}]"


# Labels, patterns and order of the built-in rules.
DEFAULT_RULES = (
    Rule("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", ("eyJ",), least=8),
    Rule("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b", ("AKIA",), least=20),
    Rule(
        "API_KEY",
        r"\b(?:sk-|ghp_|gho_|xoxb-|pk_live_|sk_live_)[A-Za-z0-9_-]{16,}\b",
        ("sk-", "ghp_", "gho_", "xoxb-", "pk_live_", "sk_live_"),
        least=19,
    ),
    Rule("BEARER", r"(?i)\bBearer\s+[A-Za-z0-9_\-\.]{20,}\b", ("bearer",), fold_case=True, least=27),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", ("@",), least=6),
    Rule("CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b", luhn=True, least=13, hint=r"\d[ \d-]{12}"),
)
IPV4_RULE = Rule(
    "IPV4",
    r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    (".",),
)

# The eight kinds of the masking redactor, case-insensitive. The
# first four and the last hide only their group, but replace the whole match.
SENSITIVE_PATTERNS = (
    ("password", r"password['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", "password", True),
    ("api_key", r"api[_-]?key['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", "key", True),
    ("token", r"token['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", "token", True),
    ("secret", r"secret['\"]?\s*[:=]\s*['\"]([^'\"]+)['\"]", "secret", True),
    ("credit_card", r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", None, False),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "-", False),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "@", False),
    ("private_key", r"-----BEGIN PRIVATE KEY-----(.+?)-----END PRIVATE KEY-----", "private key", True),
)


def select_rules(names: list[str] | None = None, include_ipv4: bool = False) -> tuple[Rule, ...]:
    """The rules to run. Asking for IPv4 always includes it, whatever the
    name list says."""
    wanted = None if names is None else {name.upper() for name in names}
    rules = [rule for rule in DEFAULT_RULES if wanted is None or rule.label in wanted]
    if include_ipv4 or (wanted is not None and IPV4_RULE.label in wanted):
        rules.append(IPV4_RULE)
    return tuple(rules)


def may_match(rule: Rule, text: Column) -> Column:
    tests = [F.octet_length(text) >= rule.least] if rule.least else []
    if rule.triggers:
        haystack = F.lower(text) if rule.fold_case else text
        found = F.contains(haystack, F.lit(rule.triggers[0]))
        for literal in rule.triggers[1:]:
            found = found | F.contains(haystack, F.lit(literal))
        tests.append(found)
    if rule.hint:
        tests.append(text.rlike(rule.hint))
    return reduce(and_, tests) if tests else F.lit(True)


def _card_digits_valid(match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, r"\D", ""))


def _replaced(rule: Rule, text: Column) -> Column:
    if rule.luhn:
        return rewrite_matches(
            text, rule.pattern, lambda m: F.when(_card_digits_valid(m), F.lit(rule.token)).otherwise(m)
        )
    return F.regexp_replace(text, rule.pattern, rule.token)


def apply_rule(rule: Rule, text: Column) -> Column:
    return F.when(may_match(rule, text), _replaced(rule, text)).otherwise(text)


def _hits(rule: Rule, text: Column) -> Column:
    if not rule.luhn:
        return F.regexp_count(text, F.lit(rule.pattern))
    hits = F.size(F.filter(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), _card_digits_valid))
    return F.when(text.rlike(rule.pattern), hits).otherwise(F.lit(0))


def count_rule(rule: Rule, text: Column) -> Column:
    return F.when(may_match(rule, text), _hits(rule, text)).otherwise(F.lit(0))


def redact_text(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES, enabled: bool = True) -> Column:
    """Text with every rule applied in order; null and empty pass through."""
    if enabled:
        for rule in rules:
            text = let(text, lambda t, rule=rule: apply_rule(rule, t))
    return text


def redact_with_counts(text: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """``struct<text, hits>``: the redacted text and the matches of each rule,
    in rule order, each counted on the text its predecessors left."""

    def step(at: int, t: Column, hits: tuple[Column, ...]) -> Column:
        if at == len(rules):
            return F.struct(t.alias("text"), F.array(*hits).cast("array<int>").alias("hits"))
        rule = rules[at]
        found = F.struct(_replaced(rule, t).alias("text"), _hits(rule, t).cast("int").alias("n"))
        nothing = F.struct(t.alias("text"), F.lit(0).alias("n"))
        return let(
            F.when(may_match(rule, t), found).otherwise(nothing),
            lambda out: step(at + 1, out["text"], (*hits, out["n"])),
        )

    return step(0, text, ())


def redact_map(column: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Redact the values of a ``map<string,string>``; keys stay as they are."""
    return F.transform_values(column, lambda _key, value: redact_text(value, rules))


def redact_nested(column: Column, data_type, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Redact every string inside a typed value, however deeply nested."""
    from pyspark.sql import types as T

    if isinstance(data_type, T.StringType):
        return redact_text(column, rules)
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda item: redact_nested(item, data_type.elementType, rules))
    if isinstance(data_type, T.MapType):
        return F.transform_values(
            column, lambda _key, value: redact_nested(value, data_type.valueType, rules)
        )
    if isinstance(data_type, T.StructType):
        rebuilt = F.struct(
            *[
                redact_nested(column.getField(field.name), field.dataType, rules).alias(field.name)
                for field in data_type.fields
            ]
        )
        return F.when(column.isNotNull(), rebuilt)
    return column


def _sensitive_regex(pattern: str) -> str:
    return "(?id)" + pattern


def _worth_scanning(trigger: str | None, text: Column) -> Column:
    return F.lit(True) if trigger is None else F.contains(F.lower(text), F.lit(trigger))


def mask_sensitive(text: Column, mask: str = "*") -> Column:
    """Replace each sensitive match by ``mask`` repeated for the length of the
    hidden value (the group where the pattern has one)."""
    for _kind, pattern, trigger, grouped in SENSITIVE_PATTERNS:
        regex = _sensitive_regex(pattern)

        def blackout(match: Column, regex=regex, grouped=grouped) -> Column:
            hidden = F.regexp_extract(match, regex, 1) if grouped else match
            return F.repeat(F.lit(mask), F.length(hidden))

        text = let(
            text,
            lambda t, regex=regex, trigger=trigger, blackout=blackout: F.when(
                _worth_scanning(trigger, t), rewrite_matches(t, regex, blackout)
            ).otherwise(t),
        )
    return text


def sensitive_fields(text: Column) -> Column:
    """``array<struct<type, value, position>>`` of the matches in the original
    text, kind by kind, with 0-based character positions."""
    row = "array<struct<type:string,value:string,position:int>>"
    found = []
    for kind, pattern, trigger, _grouped in SENSITIVE_PATTERNS:
        regex = _sensitive_regex(pattern)
        pieces = F.split(text, regex, -1)
        matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

        def locate(acc: Column, pair: Column, kind: str) -> Column:
            start = acc["at"] + F.length(pair["pieces"])
            hit = F.struct(
                F.lit(kind).alias("type"), pair["matches"].alias("value"), start.alias("position")
            )
            return F.struct(
                (start + F.coalesce(F.length(pair["matches"]), F.lit(0))).alias("at"),
                F.when(pair["matches"].isNull(), acc["hits"])
                .otherwise(F.concat(acc["hits"], F.array(hit)))
                .alias("hits"),
            )

        located = F.aggregate(
            F.arrays_zip(pieces.alias("pieces"), matches.alias("matches")),
            F.struct(F.lit(0).alias("at"), F.array().cast(row).alias("hits")),
            lambda acc, pair: locate(acc, pair, kind),  # noqa: B023 (called at once)
            lambda acc: acc["hits"],
        )
        found.append(
            F.when(_worth_scanning(trigger, text) & text.rlike(regex), located).otherwise(
                F.array().cast(row)
            )
        )
    return F.concat(*found)
