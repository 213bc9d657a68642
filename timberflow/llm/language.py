"""Language of web pages from text, markup and address.

The posterior of a language is its text likelihood, the likelihood of the
declared markup language and of the address (top-level label and a language-like
path part), times a host prior. Priors are smoothed from host to registered
suffix to top-level label to all pages; their counts come from grouped
aggregations over the text decisions of all pages.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from timberflow.llm.labelled import owner_sums, word_terms
from timberflow.llm.texts import folded, plain, row_sums, slices, words
from timberflow.session import stored

BITS, SIZES = 14, (2, 3)
BLOCK = 64  # languages scored at once
EVIDENCE = 40.0  # words after which a text adds no more certainty
SMOOTH = 5.0  # pages by which a level trusts the one above it
#: Markup between tags, scripts and styles.
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;|&#\w+;"


class TextModel(NamedTuple):
    languages: list[str]
    log_terms: np.ndarray  # 2^BITS x languages

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (rows x languages) with the length tempered to
        ``EVIDENCE`` words, and the numbers of words."""
        found = words(folded(texts))
        n = len(found.vocab)
        terms = [(t, np.maximum(1, np.bincount(t.owner, minlength=n))[:, None]) for t in word_terms(found.vocab, BITS, SIZES)]
        size, sums = np.diff(found.offsets), []
        for at in range(0, len(self.languages), BLOCK):
            part = np.ascontiguousarray(self.log_terms[:, at : at + BLOCK])
            own = np.zeros((n, part.shape[1]))
            for (owner, bucket), times in terms:
                own += owner_sums(part[bucket], owner, n) / times
            sums += [row_sums(own[found.codes, j], found.offsets) for j in range(own.shape[1])]
        total = np.stack(sums, 1)
        weight = np.minimum(size, EVIDENCE) / np.maximum(size, 1)
        return total * weight[:, None], size


def train_text(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Smoothed term shares of each language over all labelled documents,
    however few of them it has. Null labels are left out; without labels the
    model knows the language ``und`` only. A language takes 2^BITS numbers."""
    known = docs.filter(F.col(lang_col).isNotNull())
    languages = [r["lang"] for r in known.select(F.col(lang_col).alias("lang")).distinct().orderBy("lang").collect()]
    if not languages:
        return TextModel(["und"], np.zeros((1 << BITS, 1)))
    place = {name: k for k, name in enumerate(languages)}

    def count_terms(batches):
        for part in slices(batches, "text"):
            found = words(folded(plain(part.column("text"))))
            own = np.repeat([place[x] for x in part.column("lang").to_pylist()], np.diff(found.offsets))
            terms, size, keys, counts = word_terms(found.vocab, BITS, SIZES), len(found.vocab), [], []
            for k in np.unique(own).tolist():
                times, seen = np.bincount(found.codes[own == k], minlength=size), np.zeros(1 << BITS, np.int64)
                for owner, bucket in terms:
                    seen += np.bincount(bucket, times[owner], 1 << BITS).astype(np.int64)
                bucket = np.flatnonzero(seen)
                keys.append(np.stack([np.full(len(bucket), k), bucket]))
                counts.append(seen[bucket])
            if keys:
                k, bucket = np.concatenate(keys, 1)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bucket), pa.array(np.concatenate(counts))], ["k", "bucket", "n"])

    pairs = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count_terms, "k bigint, bucket bigint, n bigint")
    counts = np.full((1 << BITS, len(languages)), 0.5)
    table = pairs.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x 2^BITS rows at most
    counts[table["bucket"].to_numpy(), table["k"].to_numpy()] += table["n"].to_numpy()
    return TextModel(languages, np.log(counts / counts.sum(0)))


def _evidence(pages: DataFrame, model: TextModel, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """id, host, suffix, top, declared, segment, score (per language), n_words."""
    html, url = F.col(html_col), F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    labels = F.split(host, r"\.", -1)
    ending = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    segment = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*/([a-zA-Z]{2,3})(?:[/?#]|$)", 1))
    names = F.array(*(F.lit(x) for x in model.languages))
    code = lambda c: F.when(F.array_contains(names, c), F.array_position(names, c) - 1).otherwise(-1).cast("int")
    rows = pages.select(
        F.col(id_col).alias("id"), html.alias("html"), host.alias("host"), ending(2).alias("suffix"), ending(1).alias("top"),
        code(F.coalesce(declared, F.lit(""))).alias("declared"), code(segment).alias("segment"),
    )
    kept = [f.name for f in rows.schema.fields if f.name != "html"]

    def run(batches):
        for part in slices(batches, "html"):
            visible = pc.replace_substring_regex(plain(part.column("html")), _MARKUP, " ")
            score, size = model.score(visible)
            ends = np.arange(len(score) + 1, dtype=np.int32) * score.shape[1]
            more = {"score": pa.ListArray.from_arrays(ends, score.ravel()), "n_words": pa.array(size)}
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | more)

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
    return rows.mapInArrow(run, schema + ", score array<double>, n_words bigint")


def _shares(rows: DataFrame, level: str) -> DataFrame:
    """Pages of each language and of all at one level of addresses."""
    pairs = rows.groupBy(level, "best").count()
    return pairs.groupBy(level).agg(
        F.map_from_entries(F.collect_list(F.struct("best", "count"))).alias(f"{level}_n"), F.sum("count").alias(f"{level}_all")
    )


def _smoothed(counts: Column, total: Column, above: Column) -> Column:
    """Shares of all languages at a level, drawn to those of the level above."""
    return F.transform(above, lambda p, j: (F.coalesce(F.try_element_at(counts, j), F.lit(0)) + SMOOTH * p) / (total + SMOOTH))


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: ``id_col``, host, text_lang (null without words),
    declared, lang and probability.

    Null or empty pages are decided by address and priors; an unknown markup or
    path language is no evidence; equal posteriors go to the language that
    comes first by name. Repeated ids keep a row each, other columns are not
    read. Host counts meet the pages by an equality join on small rows.
    """
    languages = model.languages
    rows = _evidence(pages, model, id_col, html_col, url_col)
    best = F.array_position(F.col("score"), F.array_max("score")).cast("int") - 1
    rows = stored(rows.withColumn("best", F.when(F.col("n_words") > 0, best)), "evidence")
    told = rows.filter("best IS NOT NULL")
    base = {r["best"]: r["count"] for r in told.groupBy("best").count().collect()}
    size = sum(base.values()) + len(languages)
    share = F.array(*(F.lit((base.get(j, 0) + 1) / size) for j in range(len(languages))))

    def channel(name: str) -> Column:
        """Log likelihood of what a page declares, for each language; from how
        often it goes with the text decisions."""
        seen = {(r[name], r["best"]): r["count"] for r in told.filter(f"{name} >= 0").groupBy(name, "best").count().collect()}
        columns = [sum(n for (_, b), n in seen.items() if b == j) for j in range(len(languages))]
        entries = []
        for d in range(len(languages)):
            own = [np.log((seen.get((d, j), 0) + (4.0 if d == j else 0.25)) / (columns[j] + 4 + 0.25 * len(languages))) for j in range(len(languages))]
            entries += [F.lit(d), F.array(*(F.lit(float(x)) for x in own))]
        zero = F.array(*(F.lit(0.0) for _ in languages))
        return F.coalesce(F.try_element_at(F.create_map(*entries), F.col(name)), zero)

    hosts = told.groupBy("host", "suffix", "top").agg(F.lit(1).alias("one")).drop("one")
    hosts = hosts.join(_shares(told, "top"), "top").join(_shares(told, "suffix"), "suffix").join(_shares(told, "host"), "host")
    prior = _smoothed(F.col("top_n"), F.col("top_all"), share)
    prior = _smoothed(F.col("suffix_n"), F.col("suffix_all"), prior)
    prior = _smoothed(F.col("host_n"), F.col("host_all"), prior)
    hosts = stored(hosts.select("host", prior.alias("prior")), "host-priors")
    joined = rows.join(hosts, "host", "left").withColumn("prior", F.coalesce("prior", share))
    joined = joined.withColumn("markup", channel("declared")).withColumn("address", channel("segment"))
    total = F.transform("prior", lambda p, j: F.log(p) + F.get("score", j) + F.get("markup", j) + F.get("address", j))
    joined = joined.withColumn("total", total).withColumn("most", F.array_max("total"))
    mass = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    names = F.array(*(F.lit(x) for x in languages))
    return joined.select(
        F.col("id").alias(id_col),
        "host",
        F.get(names, F.col("best")).alias("text_lang"),
        F.get(names, F.when(F.col("declared") >= 0, F.col("declared"))).alias("declared"),
        F.get(names, F.array_position("total", F.col("most")).cast("int") - 1).alias("lang"),
        (1 / mass).alias("probability"),
    )
