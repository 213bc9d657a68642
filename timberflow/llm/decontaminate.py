"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents give hashed TF-IDF rows of unit length; a randomised
decomposition of their Gram matrix, summed over the partitions, gives the
leading singular vectors. The first few, which tell languages and layouts
apart, are left out. Windows of the documents are folded in next to the
benchmark items, wherever one of the words stands that every copy of an item
must hold; those of high cosine are checked word by word: the longest common subsequence
with the item, and for a looser match also its answer. Items of a few words
are looked up word by word at every position instead.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from timberflow.llm.texts import Words, folded, hashes, mix, plain, slices, spread, windows, words
from timberflow.session import stored

TERMS = 1 << 13  # hashed terms
RANK, EXTRA, COMMON = 48, 8, 6
PASSAGE = 48  # words of a passage in the statistics
STEP = 8  # words between window starts
LONGEST = 64  # words of a window; longer items are searched by their parts
COSINE = 0.5
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8  # shares of an item and of its answer found in order
SIGNAL_SHARE = 4  # one in so many words of an item must stand near a window
SHORT = 8  # items of fewer words must stand there word by word, at any place
ITEMS = 20_000  # benchmark items held by a task at once
PART_BYTES = 5 << 20
RUNS = 2048  # rows of term vectors that are worked on at once
GROUPS = 64


class Space(NamedTuple):
    """Word vectors of the hashed terms: idf times the folded-in directions."""

    vectors: np.ndarray  # TERMS x at most RANK - COMMON


def _terms(found: Words) -> np.ndarray:
    return (mix(hashes(found.vocab)) % np.uint64(TERMS)).astype(np.int64)[found.codes]


def _units(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``size`` words that do not cross texts: the first word of each,
    and the first run of each text."""
    length = np.diff(found.offsets)
    per_row = -(-length // size)
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(length)), per_row)
    return found.offsets[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * size, first


def _unit_sums(vectors: np.ndarray, terms: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the term vectors of each run of ``length`` (1 at least) terms from
    ``starts``. ``RUNS`` of them are summed at a time, so that the sums stay in
    the cache."""
    sums = np.empty((len(starts), vectors.shape[1]), vectors.dtype)
    for at in range(0, len(starts), RUNS):
        own, left, part = starts[at : at + RUNS], length[at : at + RUNS], sums[at : at + RUNS]
        part[:] = vectors[terms[own]]
        for j in range(1, int(left.max(initial=0))):
            longer = np.flatnonzero(left > j)
            if len(longer) == len(own):
                part += vectors[terms[own + j]]
            else:
                part[longer] += vectors[terms[own[longer] + j]]
    return sums


def _distinct(key: np.ndarray) -> np.ndarray:
    """Distinct keys in order. ``np.unique`` hashes them, which takes several
    times as long as sorting; ``key`` is sorted in place."""
    key.sort()
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return key[first]


def _passages(docs: DataFrame, text_col: str) -> DataFrame:
    """The distinct hashed terms of every passage: ``terms`` (16 bits each) of
    many passages in a row, ``sizes`` (8 bits) their numbers."""

    def run(batches):
        for part in slices(batches, "text", PART_BYTES):
            found = words(folded(plain(part.column("text"))))
            starts, _ = _units(found, PASSAGE)
            passage = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(found.codes))))
            key = passage * TERMS + _terms(found)
            key = _distinct(key.astype(np.uint32) if len(starts) * TERMS < 1 << 32 else key)  # short keys sort faster
            sizes = np.bincount(key // TERMS, minlength=len(starts)).astype(np.uint8)
            data = [(key % TERMS).astype(np.uint16).tobytes()], [sizes.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()) for d in data], ["terms", "sizes"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "terms binary, sizes binary")


def _unpacked(batch: pa.RecordBatch):
    for terms, sizes in zip(batch.column("terms"), batch.column("sizes"), strict=True):
        yield np.frombuffer(terms.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(sizes.as_buffer(), np.uint8)


def _frequencies(passages: DataFrame) -> tuple[int, np.ndarray]:
    """Number of passages, and of those that hold each hashed term."""

    def count(batches):
        total, seen = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            for terms, sizes in _unpacked(batch):
                seen += np.bincount(terms, minlength=TERMS)
                total += len(sizes)
        if total:
            term = np.append(np.flatnonzero(seen), -1)  # -1: all passages
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.append(seen[seen > 0], total))], ["term", "n"])

    rows = passages.mapInArrow(count, "term bigint, n bigint")
    frequency = np.zeros(TERMS + 1, np.int64)
    for term, n in rows.groupBy("term").agg(F.sum("n")).collect():  # TERMS + 1 rows at most
        frequency[term] = n
    return int(frequency[-1]), frequency[:-1]


def _summed(parts: DataFrame, width: int) -> DataFrame:
    """Sum of the ``data`` arrays of each ``block``, over ``GROUPS`` groups of
    tasks first; rows stream through, one sum per block is held."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                sums.setdefault(block, np.zeros(width, np.float64))
                sums[block] += np.frombuffer(data.as_buffer(), np.float32)
        if sums:
            data = [s.astype(np.float32).tobytes() for s in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

    out = parts
    for key in (["block", "group"], ["block"]):
        out = out.repartition(*key).select("block", "data").mapInArrow(add, "block bigint, data binary")
    return out


def fit_space(docs: DataFrame, text_col: str = "text", seed: int = 11) -> Space | None:
    """Directions over all passages of ``docs``; None without words.

    The texts are read once; their passages, as hashed terms, are kept in the
    shared folder and read for the term frequencies and for the Gram matrix
    times a random matrix. A task sends TERMS x (RANK + EXTRA) numbers, the
    driver gets their sum.
    """
    stock = stored(_passages(docs, text_col), "passages")
    passages, frequency = _frequencies(stock)
    if not passages:
        return None
    idf = np.where(frequency > 0, np.log((1 + passages) / (1 + frequency)), 0).astype(np.float32)
    width, blocks = RANK + EXTRA, 32
    random = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, width)))[0]
    probe = (random * idf[:, None]).astype(np.float32)

    def gram(batches):
        total = np.zeros((TERMS, width), np.float32)
        for batch in batches:
            for term, sizes in _unpacked(batch):
                if not len(term):
                    continue
                starts = np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)])
                norm = np.maximum(np.add.reduceat(idf[term] ** 2, starts), 1e-9)
                seen = _unit_sums(probe, term, starts, sizes.astype(np.int64)) / norm[:, None]
                passage = np.repeat(np.arange(len(sizes)), sizes)
                for j, column in enumerate(np.ascontiguousarray(seen.T)):
                    total[:, j] += np.bincount(term, column[passage], TERMS)
        data = (total * idf[:, None]).reshape(blocks, -1)
        group = np.full(blocks, TaskContext.get().partitionId() % GROUPS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(blocks)), pa.array(group), pa.array([d.tobytes() for d in data], pa.binary())],
            ["block", "group", "data"],
        )

    parts = stock.mapInArrow(gram, "block bigint, group bigint, data binary")
    image = np.zeros((TERMS, width))
    for row in _summed(parts, TERMS * width // blocks).collect():
        image[row["block"] * (TERMS // blocks) :][: TERMS // blocks] = np.frombuffer(row["data"], np.float32).reshape(-1, width)
    small = 1e-6 * np.linalg.norm(image) + 1e-12
    image += small * random
    core = random.T @ image
    core = np.linalg.cholesky((core + core.T) / 2 + small * 1e-3 * np.eye(width))
    left, strength, _ = np.linalg.svd(np.linalg.solve(core, image.T).T, full_matrices=False)
    useful = np.flatnonzero(strength[:RANK] > 1e-4 * strength[0])
    useful = useful[min(COMMON, len(useful) // 4) :]
    return Space((idf[:, None] * left[:, useful] / strength[useful]).astype(np.float32))


class Item(NamedTuple):
    number: int  # place among the items of the block
    words: tuple[str, ...]
    answer: tuple[str, ...]
    distinct: frozenset[str] = frozenset()


class Probes(NamedTuple):
    """Items by the window length of their parts: (length, item places, words
    of the item before the part, unit vectors)."""

    ids: list
    items: list[Item]
    groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    short: dict[int, dict[int, list[int]]]  # items of fewer than SHORT words: by length and hash
    vocab: pa.Array  # distinct words of the items that are not short
    owner: np.ndarray  # item and word, for the distinct words of each item, by item
    word: np.ndarray
    size: np.ndarray  # words of each item
    signals: np.ndarray  # so many distinct words, of which a copy holds at least
    least: np.ndarray


def _probes(ids: list, texts: list[str], answers: list[str | None], space: Space) -> Probes:
    split = lambda t: tuple(folded(pa.array([t]))[0].as_py().split())
    items, by_length, short = [], {}, {}
    for k, (text, answer) in enumerate(zip(texts, answers, strict=True)):
        own = split(text or "")
        # without a given answer the last quarter of the item counts as one
        items.append(Item(k, own, split(answer) if answer is not None else own[-max(1, len(own) // 4) :], frozenset(own)))
        if 0 < len(own) < SHORT:
            key = int(windows(hashes(pa.array(own)), len(own))[0])
            short.setdefault(len(own), {}).setdefault(key, []).append(k)
            continue
        for at in range(0, len(own), LONGEST):
            part = own[at : at + LONGEST]
            if len(part) >= SHORT or len(own) <= LONGEST:
                by_length.setdefault(-(-len(part) // STEP) * STEP, []).append((k, at, part))
    groups = []
    for length, parts in sorted(by_length.items()):
        found = words(pa.array([" ".join(p) for _, _, p in parts]))
        sums = np.add.reduceat(space.vectors[_terms(found)], found.offsets[:-1], axis=0)
        unit = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-12)
        groups.append((length, *(np.array([p[j] for p in parts]) for j in (0, 1)), unit))
    size = np.array([len(i.words) for i in items], np.int64)
    owned = [(i.number, w) for i in items if len(i.words) >= SHORT for w in sorted(i.distinct)]
    coded = pa.array([w for _, w in owned], pa.string()).dictionary_encode()
    # ``_confirmed`` asks for n - missing >= LIKELY * n, so that many distinct words may be missing
    missing = np.array([max((m for m in range(n + 1) if n - m >= LIKELY * n), default=0) for n in size.tolist()], np.int64)
    owner = np.array([k for k, _ in owned], np.int64)
    distinct = np.bincount(owner, minlength=len(items))
    signals = np.minimum(distinct, missing + size // SIGNAL_SHARE + 1)
    least = np.maximum(1, signals - missing)
    word = coded.indices.to_numpy().astype(np.int64)
    return Probes(ids, items, groups, short, coded.dictionary, owner, word, size, signals, least)


def common(a: tuple[str, ...], b: list[str]) -> int:
    """Length of the longest common subsequence (one bit per word of ``a``)."""
    place: dict[str, int] = {}
    for k, word in enumerate(a):
        place[word] = place.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & place.get(word, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _confirmed(item: Item, text: list[str], at: int) -> float:
    """Share of the item found in order around word ``at``, 0 if it does not
    count as a copy."""
    n = len(item.words)
    slack = n // 4 + STEP
    region = text[max(0, at - slack) : at + n + slack]
    # each distinct word that is not there is missing in every subsequence
    if n - len(item.distinct.difference(region)) < LIKELY * n:
        return 0.0
    share = common(item.words, region) / n
    if share >= SURE:
        return share
    if share >= LIKELY and item.answer and common(item.answer, region) >= ANSWER * len(item.answer):
        return share
    return 0.0


class Signals(NamedTuple):
    """Words of which a copy of an item holds ``least`` or more, by the item's
    place: those that are rarest in the texts at hand."""

    item: np.ndarray
    code: np.ndarray  # in the vocabulary of the slice


def _signals(found: Words, probes: Probes) -> Signals:
    place = pc.index_in(probes.vocab, value_set=found.vocab).fill_null(-1).to_numpy().astype(np.int64)
    n = np.bincount(found.codes, minlength=len(found.vocab) + 1)  # ends with the 0 of a word that is not there
    code = place[probes.word]
    order = np.lexsort((n[code], probes.owner))
    nth = np.arange(len(order)) - np.searchsorted(probes.owner, probes.owner)
    rare = order[nth < probes.signals[probes.owner]]
    rare = rare[code[rare] >= 0]
    return Signals(probes.owner[rare], code[rare])


def _near(starts: np.ndarray, item: np.ndarray, at: np.ndarray, probes: Probes, behind: int) -> np.ndarray:
    """Places in ``starts`` from where a copy of an item could be confirmed:
    around ``least`` of its signal words (``item``, ``at``: all their places) that
    stand no farther apart than the words that are compared. The start of an
    item may lie up to ``behind`` words before the window."""
    order = np.lexsort((at, item))
    item, at = item[order], at[order]
    last = np.arange(len(at)) + probes.least[item] - 1  # the place that completes the number
    slack = probes.size[item] // 4 + STEP
    inside = last < len(at)
    inside[inside] = item[last[inside]] == item[inside]
    inside[inside] &= at[last[inside]] - at[inside] < (probes.size[item] + 2 * slack)[inside]
    first = at[last[inside]] - probes.size[item[inside]] - slack[inside]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.searchsorted(starts, first), 1)
    np.add.at(change, np.searchsorted(starts, at[inside] + slack[inside] + behind, side="right"), -1)
    return np.flatnonzero(np.cumsum(change[:-1]))


def _matches(texts: pa.Array, space: Space, probes: Probes) -> dict[tuple[int, int], tuple[float, float]]:
    """(row, item place) of all confirmed matches, with share and cosine.
    Windows are folded in only where a signal word of an item stands near."""
    found = words(folded(texts))
    out: dict[tuple[int, int], tuple[float, float]] = {}
    n = len(found.codes)
    if not n:
        return out
    _look_up(found, probes, out)
    signals = _signals(found, probes)
    wanted = np.zeros(len(found.vocab), bool)
    wanted[signals.code] = True
    at = np.flatnonzero(wanted[found.codes])
    at = at[np.argsort(found.codes[at], kind="stable")]
    code = found.codes[at]  # occurrences of the signal words, by word
    every, (runs, _) = np.arange(n), _units(found, STEP)
    terms, vocab, split = None, found.vocab.to_pylist() if len(at) else [], {}

    def text(r: int) -> list[str]:
        if r not in split:
            split[r] = [vocab[c] for c in found.codes[found.offsets[r] : found.offsets[r + 1]].tolist()]
        return split[r]

    for length, place, offset, unit in probes.groups:
        dense = length <= 2 * STEP  # a window at every word
        starts, step = (every, 1) if dense else (runs, STEP)
        own = np.isin(signals.item, place)
        item, word = signals.item[own], signals.code[own]
        lo, hi = np.searchsorted(code, word), np.searchsorted(code, word, side="right")
        pos, _ = spread(at, lo, hi - lo)
        window_at = starts[_near(starts, np.repeat(item, hi - lo), pos, probes, int(offset.max(initial=0)))]
        if terms is None and len(window_at):
            terms = _terms(found)
        for k in range(0, len(window_at), RUNS):
            begin = window_at[k : k + RUNS]
            row = np.searchsorted(found.offsets, begin, side="right") - 1
            end = found.offsets[row + 1]
            window = np.zeros((len(begin), space.vectors.shape[1]), space.vectors.dtype)
            for run in range(0, length, step):
                inside = np.flatnonzero(begin + run < end)
                window[inside] += _unit_sums(space.vectors, terms, begin[inside] + run, np.minimum(step, end[inside] - begin[inside] - run))
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))[:, None] + 1e-12
            score = window @ unit.T
            score /= norm
            for flat in np.flatnonzero(score >= COSINE).tolist():
                w, p = divmod(flat, score.shape[1])
                r, of = int(row[w]), probes.items[place[p]]
                if out.get((r, of.number), (0.0, 0.0))[0] == 1.0:
                    continue
                share = _confirmed(of, text(r), int(begin[w] - found.offsets[r] - offset[p]))
                if share > 0:
                    out[r, of.number] = max(out.get((r, of.number), (0.0, 0.0)), (share, float(score[w, p])))
    return out


def _look_up(found: Words, probes: Probes, out: dict[tuple[int, int], tuple[float, float]]) -> None:
    """Add the items of fewer than ``SHORT`` words that stand in a text, found
    by the hash of the words at every position; equal words have cosine 1."""
    if not probes.short:
        return
    h = hashes(found.vocab)[found.codes]
    row = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    for n, known in probes.short.items():
        at = windows(h, n)
        hit = np.flatnonzero(np.isin(at, np.array(list(known), np.uint64)))
        hit = hit[hit + n <= found.offsets[row[hit] + 1]]
        for r, key in {*zip(row[hit].tolist(), at[hit].tolist(), strict=True)}:
            for k in known[key]:
                out[r, k] = (1.0, 1.0)


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    space: Space | None,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``matches``, an array of (item, share, cosine), empty where
    a document repeats no item; one row for each row, nothing is shuffled.

    Null and empty texts match nothing; items without words match nothing;
    items with a null id are left out; repeated items are listed each. A column
    named matches is replaced. The benchmark is the query set: it is taken in
    blocks of ``ITEMS`` items, each a further step over all rows.
    """
    spark = docs.sparkSession
    rows = docs.drop("matches").withColumn("matches", F.expr("array()").cast("array<struct<item:bigint,share:double,cosine:double>>"))
    if space is None:
        return rows
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    wanted = benchmark.filter(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text"), answer.alias("answer")
    )
    held: list = []

    def step(df: DataFrame) -> DataFrame:
        probes = _probes(*([r[k] for r in held] for k in range(3)), space)

        def run(batches):
            for part in slices(batches, text_col, PART_BYTES):
                fresh: dict[int, list] = {}
                for (r, k), (share, cosine) in sorted(_matches(plain(part.column(text_col)), space, probes).items()):
                    fresh.setdefault(r, []).append({"item": probes.ids[k], "share": share, "cosine": cosine})
                columns = {n: part.column(n) for n in part.schema.names}
                old = columns["matches"].to_pylist()
                columns["matches"] = pa.array(
                    [o + fresh.get(r, []) for r, o in enumerate(old)], part.schema.field("matches").type
                )
                yield pa.RecordBatch.from_pydict(columns)

        return df.mapInArrow(run, ", ".join(names))

    for item in wanted.orderBy("id", "text").toLocalIterator():
        held.append(item)
        if len(held) == ITEMS:
            rows, held = step(rows), []
    return step(rows) if held else rows
