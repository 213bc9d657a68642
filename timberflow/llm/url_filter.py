"""URL verdicts: the longest fitting rule, else gradient-boosted trees on
lexical features, trained on the URLs that the rules decide. Column expressions
and Spark ML only."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from timberflow.session import stored

TRAIN_ROWS = 20_000
SUFFIX_BUCKETS = 4096
ROUNDS, DEPTH = 12, 4
FEATURES = (
    "length", "host_length", "depth", "labels", "digit_ratio", "mark_ratio", "hyphens", "entropy", "parameters",
    "has_fragment", "is_https", "top_odds", "suffix_odds",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits: struct<size, rule, verdict>, else null. A
    rule fits its host and its subdomains if the path starts with the rule's.
    Rules of a host are found by each ending of the url's host; of rules of one
    length the larger text wins, of equal ones block."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    entries = []
    for name, own in by_host.items():
        known = [
            F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))
            for r in own
        ]
        entries += [F.lit(name), F.array(*known)]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.transform(endings, lambda e: F.coalesce(F.try_element_at(table, e), F.array())))
    best = F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _bucket(labels: Column, count: int) -> Column:
    """Hash bucket of the last labels of a host."""
    last = F.array_join(F.slice(labels, F.greatest(F.size(labels) - count + 1, F.lit(1)), F.lit(count)), ".")
    return F.pmod(F.xxhash64(last), F.lit(SUFFIX_BUCKETS)).cast("int")


def _features(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the features that need no statistics."""
    url, labels = F.coalesce("url", F.lit("")), F.split("host", r"\.", -1)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    without = lambda pattern: F.length(F.regexp_replace(url, pattern, ""))
    chars = F.array_distinct(F.split(F.regexp_replace(url, r"[\r\n]", " "), ""))
    count = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))).cast("double")
    spread = F.aggregate(
        F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.when(count(c) > 0, count(c) * F.log2(count(c))).otherwise(0.0)
    )
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return rows.withColumns(
        {
            "length": n,
            "host_length": F.length("host").cast("double"),
            "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
            "labels": F.size(labels).cast("double"),
            "digit_ratio": (F.length(url) - without("[0-9]")) / n,
            "mark_ratio": (F.length(url) - without("[^A-Za-z0-9]")) / n,
            "hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "entropy": F.log2(n) - spread / n,
            "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&", -1)).cast("double")),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "is_https": F.startswith(url, F.lit("https://")).cast("double"),
            "top_bucket": _bucket(labels, 1),
            "suffix_bucket": _bucket(labels, 2),
        }
    )


def _odds(labelled: DataFrame, bucket: str, name: str) -> DataFrame:
    """Smoothed log odds of block of each bucket: ``SUFFIX_BUCKETS`` rows at most."""
    block = F.sum((F.col("label") == 1).cast("double"))
    rest = F.sum((F.col("label") == 0).cast("double"))
    return labelled.groupBy(bucket).agg(F.log((block + 1) / (rest + 1)).alias(name))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row of ``pages``: ``id_col``, host, path, rule, verdict, score.

    ``rule`` is null where none fits; then ``verdict`` is the method's: block
    from a score of one half on. Null urls and urls without :// have an empty
    host and path, fit no rule and are scored as empty or unusual texts. When
    the rules decide no row, or all in one way, everything else is allowed with
    score 0. Repeated rows keep a row each; other columns are not read.

    The trees learn from at most ``train_rows`` rows, picked by a hash of the
    url; suffix statistics cover all rows that a rule decides. They fill at
    most ``SUFFIX_BUCKETS`` rows, so they may be broadcast.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("label", F.when(F.col("hit.verdict").isNotNull(), (F.col("hit.verdict") == "block").cast("int")))
    rows = stored(_features(rows), "url-features")
    labelled = rows.filter("label IS NOT NULL")
    plain = rows.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"),
    )
    if labelled.select("label").distinct().count() < 2:
        return plain
    top, suffix = _odds(labelled, "top_bucket", "top_odds"), _odds(labelled, "suffix_bucket", "suffix_odds")

    def assembled(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(top), "top_bucket", "left").join(F.broadcast(suffix), "suffix_bucket", "left")
        df = df.fillna(0.0, ["top_odds", "suffix_odds"])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    # half of each label at most
    order = [F.xxhash64("url"), F.col("id")]
    parts = [labelled.filter(F.col("label") == k).orderBy(*order).limit(train_rows // 2) for k in (0, 1)]
    sample = stored(assembled(parts[0].unionAll(parts[1])).select("label", "features"), "url-sample")
    trees = GBTClassifier(labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=5).fit(sample)
    scored = trees.transform(assembled(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", verdict).alias("verdict"), "score",
    )
