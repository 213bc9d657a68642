"""Phrase collocations from Rabin-Karp fingerprints of word n-grams.

Texts become runs of word numbers, kept in the shared folder. Prefix polynomials
over word hashes give the fingerprint of every n-gram with one subtraction. An
n-gram can only be frequent if the two shorter ones in it are, so each length is
counted among the n-grams whose parts passed a filter of fixed size, which
may let a rare one through and never stops a frequent one. Occurrences of
fingerprints that pass are compared with the text they point to, counted by
fingerprint and text digest, and only frequent phrases are read back from the
text at their pointer. The counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from timberflow.llm.texts import hashes, mix, plain, raw_bytes, slices
from timberflow.session import stored

SLICE = 2 << 20  # bytes of text in a row of runs; what a task holds besides its filters goes with it
LONGEST, LEAST, FIRST = 5, 100, 2000
FILTER_BITS = 1 << 27  # at most: 16 MB on the driver and in a task, of any corpus; a filter takes 16 bits a fingerprint
SALTS = 64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64

# Fixed values of the contract: marks that end a piece, blanks that end a word.
_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_runs(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts in a row, and the piece that each belongs to; no
    piece goes beyond its text. Only A-Z are lower-cased."""
    body, bounds = raw_bytes(texts)
    body = _LOWER[body]
    ends = _PIECE_END[body]
    inside = ~(ends | _BLANK[body])
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    rows = bounds[1:-1]
    opens[rows[rows < len(body)]] |= inside[rows[rows < len(body)]]
    starts = np.flatnonzero(opens)
    piece = np.cumsum(ends)[starts] + np.searchsorted(bounds, starts, side="right")
    before = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(before[starts], before[-1]).astype(np.int32)
    data = [pa.py_buffer(x) for x in (offsets.tobytes(), body[inside].tobytes())]
    return pa.StringArray.from_buffers(len(starts), *data), piece


def token_runs(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """slice, lang, n, words (distinct), hashes (of these), codes (a number per
    word of the texts, -1 between pieces): one row per language of a batch of
    texts."""
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"))

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", SLICE):
            texts, langs = plain(part.column("text")), part.column("lang").dictionary_encode()
            of_row = langs.indices.to_numpy()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                found, piece = word_runs(texts.filter(pa.array(of_row == k)))
                if not len(found):
                    continue
                coded = found.dictionary_encode()
                gaps = np.flatnonzero(np.diff(piece)) + 1
                codes = np.insert(coded.indices.to_numpy(), gaps, -1).astype(np.int32)
                columns = [
                    pa.array([place], pa.int64()), pa.array([lang], pa.string()), pa.array([len(found)], pa.int64()),
                    pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
                    pa.array([hashes(coded.dictionary).tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "lang", "n", "words", "hashes", "codes"])
                place += 1

    return rows.mapInArrow(run, "slice bigint, lang string, n bigint, words array<string>, hashes binary, codes binary")


class Filter(NamedTuple):
    """Set of fingerprints as bits, a power of two of them."""

    bits: np.ndarray

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = prints & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


class Run(NamedTuple):
    codes: np.ndarray
    sums: np.ndarray  # prefix polynomial in the inverse of BASE
    powers: np.ndarray
    left: np.ndarray  # words from each place to the end of its piece
    seed: np.uint64

    def prints(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams of ``size`` words, and their fingerprints."""
        at = np.flatnonzero(self.left >= size)
        poly = self.sums[at + size]
        poly -= self.sums[at]
        poly *= self.powers[at]
        poly += self.seed + np.uint64(size)
        return at, mix(poly)


def _run(lang: str, word_hashes: np.ndarray, codes: np.ndarray) -> Run:
    n = len(codes)
    # at the k-th word: its hash times BASE^-k; powers[k] is BASE^k
    powers = np.full(n, np.uint64(pow(BASE, -1, 1 << 64)), np.uint64)
    powers[:1] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.append(word_hashes, np.uint64(0))[codes] * np.cumprod(powers), out=sums[1:])
    powers[1:] = np.uint64(BASE)
    np.cumprod(powers, out=powers)
    gap = np.append(np.flatnonzero(codes < 0), n)
    left = (gap[np.searchsorted(gap, np.arange(n))] - np.arange(n)).astype(np.int32)
    return Run(codes, sums, powers, left, np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, Run]]:
    """Rows of a batch of ``token_runs``, one at a time."""
    view = lambda name, row, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
    for row in range(batch.num_rows):
        yield row, _run(batch.column("lang")[row].as_py(), view("hashes", row, np.uint64), view("codes", row, np.int32))


def _candidates(run: Run, size: int, shorter: Filter | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and fingerprints of the n-grams whose two parts of one word less
    pass the filter."""
    at, prints = run.prints(size)
    if shorter is None:
        return at, prints
    passed = np.zeros(len(run.codes) + 1, bool)
    start, part = run.prints(size - 1)
    passed[start] = shorter.has(part)
    both = passed[at] & passed[at + 1]
    return at[both], prints[both]


def _frequent(runs: DataFrame, size: int, shorter: Filter | None, least: int) -> Filter:
    """The fingerprints of n-grams of ``size`` words that occur ``least`` times
    or more, as bits; the driver gets the bits alone."""

    def count(batches):
        for batch in batches:
            for _, run in _runs(batch):
                prints, n = np.unique(_candidates(run, size, shorter)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(n.astype(np.int64))], ["print", "n"])

    counted = runs.select("lang", "hashes", "codes").mapInArrow(count, "print bigint, n bigint")
    frequent = counted.groupBy("print").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("print")
    frequent = stored(frequent, f"prints-{size}")
    width = min(FILTER_BITS, max(64, 1 << (16 * frequent.count()).bit_length()))
    place = F.expr(f"cast(print & {width - 1} as int)")
    bits = (
        frequent.groupBy(F.shiftright(place, 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(print & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(width >> 6, np.uint64)
    if bits.num_rows:
        out[bits["word"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return Filter(out)


def _pointed(run: Run, vocab: list[bytes], size: int, filters: list[Filter]) -> dict[str, pa.Array] | None:
    """Counts of the run's n-grams that pass, each with its first place and the
    digest of its text. Every occurrence is compared, word by word, with the
    place that stands for it."""
    at, prints = _candidates(run, size, filters[size - 2] if size > 1 else None)
    if size <= len(filters):
        held = filters[size - 1].has(prints)
        at, prints = at[held], prints[held]
    if not len(at):
        return None
    found, first, owner, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    places, same = at[first], np.ones(len(at), bool)
    for j in range(size):
        same &= run.codes[at + j] == run.codes[places[owner] + j]
    if not same.all():  # another text with this fingerprint: counted by its words
        odd = at[~same]
        grams = np.stack([run.codes[odd + j] for j in range(size)], 1)
        _, where, more = np.unique(grams, axis=0, return_index=True, return_counts=True)
        n = np.concatenate([np.bincount(owner[same], minlength=len(found)), more])
        found, places = np.concatenate([found, prints[~same][where]]), np.concatenate([places, odd[where]])
    grams = np.stack([run.codes[places + j] for j in range(size)], 1).tolist()
    digests = [xxhash.xxh3_128_digest(b" ".join([vocab[c] for c in gram])) for gram in grams]
    return {
        "size": pa.array(np.full(len(places), size, np.int32)),
        "print": pa.array(found.view(np.int64)),
        "digest": pa.array(digests, pa.binary()),
        "n": pa.array(n.astype(np.int64)),
        "at": pa.array(places.astype(np.int64)),
    }


def frequent_phrases(runs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, f: all word n-grams of up to ``longest`` words with
    ``least`` occurrences or more, over ``token_runs``."""
    filters: list[Filter] = []
    for size in range(1, longest):
        filters.append(_frequent(runs, size, filters[-1] if filters else None, least))
    share = runs.sparkSession.sparkContext.broadcast([f.bits for f in filters])  # FILTER_BITS each

    def verify(batches):
        held = [Filter(bits) for bits in share.value]
        for batch in batches:
            for row, run in _runs(batch):
                vocab = batch.column("words")[row].values.cast(pa.binary()).to_pylist()
                for size in range(1, longest + 1):
                    counted = _pointed(run, vocab, size, held)
                    if counted is not None:
                        number = pa.array(np.full(len(counted["n"]), batch.column("slice")[row].as_py()))
                        yield pa.RecordBatch.from_pydict(counted | {"slice": number})

    pointers = (
        runs.select("slice", "lang", "words", "hashes", "codes")
        .mapInArrow(verify, "size int, print bigint, digest binary, n bigint, at bigint, slice bigint")
        .groupBy("size", "print", "digest")
        .agg(F.sum("n").alias("f"), F.min("slice").alias("slice"), F.min_by("at", "slice").alias("at"))
        .filter(F.col("f") >= least)
        .groupBy("slice")  # a slice holds its own pointers only, so these are bounded by it
        .agg(F.collect_list(F.struct("size", "f", "at")).alias("found"))
    )

    def materialise(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                vocab = batch.column("words")[row].values
                codes = np.frombuffer(batch.column("codes")[row].as_buffer(), np.int32)
                found = batch.column("found")[row].values
                size, at = (found.field(name).to_numpy() for name in ("size", "at"))
                words = vocab.take(pa.array(np.concatenate([codes[a : a + k] for a, k in zip(at, size, strict=True)])))
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), words)
                lang = pa.array([batch.column("lang")[row].as_py()] * len(found), pa.string())
                columns = [lang, pa.array(size.astype(np.int64)), pc.binary_join(lists, " "), found.field("f")]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])

    joined = pointers.join(runs.select("slice", "lang", "words", "codes"), "slice")
    return joined.mapInArrow(materialise, "lang string, size bigint, phrase string, f bigint")


def scored(cuts: DataFrame) -> DataFrame:
    """``cuts`` with score floor(1000 a n / (l r)), exact up to 38 digits."""
    times = lambda x, y: F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")
    both = cuts.withColumns({"over": (times("a", "n") * 1000).cast("decimal(38,0)"), "under": times("l", "r")})
    return both.withColumn("score", F.expr("over div under")).drop("over", "under")


def _part(size: Column, start: Column, words: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    first: int = FIRST,
) -> DataFrame:
    """The ``first`` phrases of each language by the score of their weakest
    cut: lang, rank, phrase, a, l, r, n, score.

    Null and empty texts have no words, a null language counts as ``und``;
    repeated rows count as often as they stand there; other columns are not
    read. Ties go by count, then by the bytes of the phrase; among cuts to the
    shortest first part. A table without words gives no rows. Texts are read
    whole; one very long text is one batch.
    """
    runs = stored(token_runs(docs, text_col, lang_col), "token-runs")
    totals = runs.groupBy("lang").agg(F.sum("n").alias("n"))
    known = stored(frequent_phrases(runs, longest, least), "phrases")
    phrases = known.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda name: known.select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name))
    cuts = scored(
        phrases.withColumn("cut", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("size") - 1)))
        .withColumn("l_phrase", F.array_join(F.slice("words", F.lit(1), F.col("cut").cast("int")), " "))
        .withColumn("r_phrase", F.array_join(F.slice("words", (F.col("cut") + 1).cast("int"), (F.col("size") - F.col("cut")).cast("int")), " "))
        .drop("words", "size")
        .join(part("l"), ["lang", "l_phrase"])
        .join(part("r"), ["lang", "r_phrase"])
        .join(totals, "lang")
    )
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x"))
    # a phrase as frequent in a longer one is so in one that is one word longer
    longer = phrases.filter("size > 2")
    inner = [_part((F.col("size") - 1).cast("int"), F.lit(start), F.col("words")) for start in (1, 2)]
    covered = (
        longer.select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("a").alias("within"))
        .groupBy("lang", "phrase")
        .agg(F.max("within").alias("within"))
    )
    kept = (
        weakest.join(covered, ["lang", "phrase"], "left")
        .filter(F.col("within").isNull() | (F.col("within") < F.col("x.a")))
        .select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    ahead = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    ranked = ahead.filter(F.col("place") <= first).withColumn("rank", rank).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
