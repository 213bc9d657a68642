"""Quality rules: exact counts per text, and a calibrated logistic regression
over hashed word and character n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from timberflow.llm.labelled import Sample, labelled_sample, owner_sums, word_terms
from timberflow.llm.texts import Words, hashes, mix, plain, raw_bytes, row_sums, slices, windows, words

BITS = 16
SIZES = (3, 4)
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
KEEP_FROM = 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def rule_counts(texts: pa.Array, found: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word that equal an earlier line) and n_repeat_words (words in
    8-word windows that stand twice or more in the text) of each text. Windows
    are compared by 64-bit hashes."""
    n = len(texts)
    body, bounds = raw_bytes(texts)
    lists = pc.split_pattern(texts, "\n")
    lines, ends = lists.flatten(), lists.offsets.to_numpy()
    row = np.repeat(np.arange(n), np.diff(ends))
    full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    coded = lines.dictionary_encode()
    key = row[full] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()[full]
    distinct = np.unique(key) // max(1, len(coded.dictionary))
    chars = pc.utf8_length(found.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
    return {
        "n_words": np.diff(found.offsets),
        "word_chars": row_sums(chars[found.codes], found.offsets),
        "n_symbols": row_sums(_SYMBOL[body].astype(np.int64), bounds),
        "n_dup_lines": np.bincount(row[full], minlength=n) - np.bincount(distinct, minlength=n),
        "n_repeat_words": _repeated(found, n),
    }


def _repeated(found: Words, n: int) -> np.ndarray:
    h = windows(hashes(found.vocab)[found.codes], WINDOW)
    row = np.repeat(np.arange(n), np.diff(found.offsets))
    at = np.flatnonzero(row[: len(h)] == row[WINDOW - 1 :][: len(h)]) if len(h) else np.empty(0, np.int64)
    if not len(at):
        return np.zeros(n, np.int64)
    h = mix(h[at] + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(found.codes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return row_sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), found.offsets)


class QualityModel(NamedTuple):
    """Weights per hashed term, and the line that calibrates their mean."""

    weights: np.ndarray
    slope: float
    shift: float

    def margin(self, found: Words) -> np.ndarray:
        """Mean weight of the terms of a text's words and word pairs."""
        w = np.zeros(len(found.vocab))
        for owner, bucket in word_terms(found.vocab, BITS, SIZES):
            sums = owner_sums(self.weights[bucket], owner, len(w))
            w += sums / np.maximum(1, np.bincount(owner, minlength=len(w)))
        total = row_sums(w[found.codes], found.offsets)
        pair, inside = _pairs(found)
        total += row_sums(np.append(self.weights[pair] * inside, np.zeros(min(1, len(found.codes)))), found.offsets)
        return total / np.maximum(1, np.diff(found.offsets))

    def probability(self, found: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -30, 30)))


def _pairs(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word with the next one, and whether both are in a text."""
    h = windows(hashes(found.vocab)[found.codes], 2)
    row = np.repeat(np.arange(len(found.offsets) - 1), np.diff(found.offsets))
    return (mix(h + np.uint64(2)) >> np.uint64(64 - BITS)).astype(np.int64), row[1:] == row[:-1]


def fit(sample: Sample, steps: int = 120, decay: float = 1e-6) -> QualityModel:
    """Weighted logistic loss over four folds (all rows in each step, Adam);
    the fifth fold calibrates. Without rows of both labels every text gets the
    share of label 1 (1 without rows)."""
    size, y = 1 << BITS, sample.labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 1.0
        return QualityModel(np.zeros(size), 0.0, 30.0 if share == 1 else -30.0)
    found = words(sample.texts)
    n_docs, n_words = len(y), len(found.vocab)
    length = np.maximum(1, np.diff(found.offsets))
    row = np.repeat(np.arange(n_docs), np.diff(found.offsets))
    key, count = np.unique(row * n_words + found.codes, return_counts=True)
    doc, word = key // n_words, key % n_words
    part = (count / length[doc]).astype(np.float32)
    pair, inside = _pairs(found)
    pair_key, pair_count = np.unique(row[:-1][inside] * size + pair[inside], return_counts=True)
    pair_doc, pair = pair_key // size, pair_key % size
    pair_part = (pair_count / length[pair_doc]).astype(np.float32)
    terms = [(o, b, (1 / np.bincount(o, minlength=n_words)[o]).astype(np.float32)) for o, b in word_terms(found.vocab, BITS, SIZES)]
    by_word = np.argsort(word, kind="stable")
    learn = sample.folds != 0 if 0 < (sample.folds != 0).sum() < n_docs else np.ones(n_docs, bool)
    weight = sample.weights * learn
    weight = weight / weight.sum()
    w, bias = np.zeros(size), 0.0
    first, second, first_b, second_b = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        wu = sum(owner_sums(w[b].astype(np.float32) * f, o, n_words) for o, b, f in terms)
        margin = owner_sums(wu[word] * part, doc, n_docs).astype(np.float64)
        margin += owner_sums(w[pair].astype(np.float32) * pair_part, pair_doc, n_docs)
        error = weight * (1 / (1 + np.exp(-np.clip(margin + bias, -30, 30))) - y)
        reach = owner_sums((error[doc] * part)[by_word], word[by_word], n_words)
        grad = np.bincount(pair, error[pair_doc] * pair_part, size) + decay * w
        for o, b, f in terms:
            grad += np.bincount(b, reach[o] * f, size)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        g = error.sum()
        first_b, second_b = 0.9 * first_b + 0.1 * g, 0.99 * second_b + 0.01 * g * g
        up, down = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.2 * (first / up) / (np.sqrt(second / down) + 1e-8)
        bias -= 0.05 * (first_b / up) / (np.sqrt(second_b / down) + 1e-8)
    model = QualityModel(w, 1.0, bias)
    judge = ~learn if (~learn).any() and 0 < y[~learn].mean() < 1 else np.ones(n_docs, bool)
    slope, shift = _calibrate(model.margin(found)[judge], y[judge], sample.weights[judge])
    return QualityModel(w, slope, shift)


def _calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-out margins (Newton
    steps, with targets drawn in a little so that they stay finite)."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = margin.std() + 1e-9
    x = np.stack([(margin - margin.mean()) / spread, np.ones(len(margin))], 1)
    line = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        line -= np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-4 * line), -2, 2)
    return float(line[0] / spread), float(line[1] - line[0] * margin.mean() / spread)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", **bounds) -> QualityModel:
    """Fit on a bounded sample (``labelled.SAMPLE_ROWS``, ``SAMPLE_BYTES``) of
    labelled rows."""
    return fit(labelled_sample(docs, labels, label_col, id_col, **bounds))


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with the rule counts, base_failed, quality (calibrated
    probability of label 1) and kept, one row for each row.

    A null or empty text has counts of 0 and fails the base rules. Columns of
    these names are replaced; nothing is shuffled.
    """
    rows = docs.drop(*RULES, "base_failed", "quality", "kept")

    def run(batches):
        for part in slices(batches, text_col):
            texts = plain(part.column(text_col))
            found = words(texts)
            counts = rule_counts(texts, found)
            n = counts["n_words"]
            failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * n)
            quality = model.probability(found)
            more = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
            more |= {"base_failed": pa.array(failed), "quality": pa.array(quality)}
            more["kept"] = pa.array(~failed & (quality >= keep_from))
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in part.schema.names} | more)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    schema += [f"{k} bigint" for k in RULES] + ["base_failed boolean", "quality double", "kept boolean"]
    return rows.select([F.col(f"`{c}`") for c in rows.columns]).mapInArrow(run, ", ".join(schema))
