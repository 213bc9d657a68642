"""Toxicity by a factorization machine over hashed terms.

Every distinct word of a text brings hashed terms: itself and its byte n-grams.
The machine adds a weight per term and the products of the factors of all pairs
of terms, so combinations count that no single term shows. All terms of
``LEAST_DOCS`` training texts or more are learnt, whether or not they tell the
labels apart alone; those that do not are held by a stronger weight decay. A
rare insult tells them apart by standing in texts of one label only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from timberflow.llm.labelled import Sample, labelled_sample, owner_sums, word_terms
from timberflow.llm.texts import folded, plain, slices, words

BITS = 18
SIZES = (5, 7)
FACTORS = 6
STEPS = 150
LEAST_DOCS = 3
ALONE = 4.0  # standard errors from which a term tells the labels apart alone
PURE = 10.0  # bits: a term of one label only does so, too, where chance would give that once in 2^PURE
DECAY, STRONG = 3e-3, 100.0  # of terms that tell the labels apart and of chance; divided by the number of texts


class FactorMachine(NamedTuple):
    bias: float
    linear: np.ndarray  # 2^BITS, 0 for terms that were not learnt
    factors: np.ndarray  # 2^BITS x FACTORS, likewise

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; an empty one gets the bias."""
        doc, word, vocab = _distinct(texts)
        n = len(vocab)
        w, p, q = np.zeros(n, np.float32), np.zeros((n, self.factors.shape[1]), np.float32), np.zeros(n, np.float32)
        for owner, bucket in word_terms(vocab, BITS, SIZES):
            v = self.factors[bucket]
            w += owner_sums(self.linear[bucket], owner, n)
            p += owner_sums(v, owner, n)
            q += owner_sums((v * v).sum(1), owner, n)
        total = owner_sums(p[word], doc, len(texts)).astype(np.float64)
        pairs = 0.5 * ((total**2).sum(1) - owner_sums(q[word].astype(np.float64), doc, len(texts)))
        return _sigmoid(self.bias + owner_sums(w[word].astype(np.float64), doc, len(texts)) + pairs)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pairs (row, distinct word), and the words; case and marks do not
    count."""
    found = words(folded(texts))
    row = np.repeat(np.arange(len(texts)), np.diff(found.offsets))
    key = np.unique(row * max(1, len(found.vocab)) + found.codes)
    return key // max(1, len(found.vocab)), key % max(1, len(found.vocab)), found.vocab


def _terms_of(doc: np.ndarray, word: np.ndarray, owner: np.ndarray, bucket: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms of at least ``LEAST_DOCS`` documents, and those whose share of
    documents differs between the labels by ``ALONE`` standard errors, or that
    so many documents of one label have and none of the other."""
    by_owner = np.argsort(owner, kind="stable")
    sorted_bucket = bucket[by_owner]
    bounds = np.searchsorted(owner[by_owner], np.arange(owner.max(initial=-1) + 2))
    counts = np.zeros((2, 1 << BITS))
    ends = np.searchsorted(doc, np.arange(len(positive) + 1))
    for d, label in enumerate(positive.astype(int).tolist()):
        own = word[ends[d] : ends[d + 1]]
        if len(own):
            found = np.unique(np.concatenate([sorted_bucket[bounds[u] : bounds[u + 1]] for u in own.tolist()]))
            counts[label, found] += 1
    n = np.array([[(~positive).sum()], [positive.sum()]])
    share, pooled = counts / n, counts.sum(0) / n.sum()
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n).sum())
    pure = (counts.min(0) == 0) & ((counts * -np.log2(n / n.sum())).max(0) >= PURE)
    return counts.sum(0) >= LEAST_DOCS, pure | (np.abs(share[1] - share[0]) >= ALONE * error)


def fit(sample: Sample, factors: int = FACTORS, steps: int = STEPS, decay: float = DECAY, strong: float = STRONG, seed: int = 7) -> FactorMachine:
    """Weighted logistic loss, all rows in each step (Adam). Without rows of
    both labels the machine answers with the share of label 1 (0 without
    rows)."""
    size = 1 << BITS
    y, weight = sample.labels.astype(np.float64), sample.weights
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        bias = 30.0 if share == 1 else -30.0
        return FactorMachine(bias, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    doc, word, vocab = _distinct(sample.texts)
    n_docs, n_words = len(y), len(vocab)
    terms = word_terms(vocab, BITS, SIZES)
    owner, bucket = np.concatenate([t.owner for t in terms]), np.concatenate([t.buckets for t in terms])
    frequent, alone = _terms_of(doc, word, owner, bucket, y > 0)
    keep = frequent[bucket]
    order = np.argsort(owner[keep], kind="stable")
    owner, bucket = owner[keep][order], bucket[keep][order]
    known = np.zeros(n_words, bool)
    known[owner] = True
    doc, word = doc[known[word]], word[known[word]]
    used, local = np.unique(bucket, return_inverse=True)
    pulled = (np.where(alone[used], decay, strong) / n_docs).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [
        np.array([np.log((weight * y).sum() / (weight * (1 - y)).sum())], np.float32),
        np.zeros(len(used), np.float32),
        rng.normal(0, 0.02, (len(used), factors)).astype(np.float32),
    ]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_word = np.argsort(word, kind="stable")
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        w, v = params[1], params[2]
        vt = v[local]
        wu, pu, qu = owner_sums(w[local], owner, n_words), owner_sums(vt, owner, n_words), owner_sums((vt * vt).sum(1), owner, n_words)
        total = owner_sums(pu[word], doc, n_docs)
        z = params[0] + owner_sums(wu[word], doc, n_docs) + 0.5 * ((total**2).sum(1) - owner_sums(qu[word], doc, n_docs))
        error = (weight * (_sigmoid(z) - y)).astype(np.float32)
        # of a term: its error over documents, and that times the document's sum
        reach = owner_sums(error[doc[by_word]], word[by_word], n_words)
        pull = owner_sums((error[:, None] * total)[doc[by_word]], word[by_word], n_words)
        g_w = np.bincount(local, reach[owner], len(used)).astype(np.float32)
        g_v = np.stack([np.bincount(local, pull[owner, f], len(used)) for f in range(factors)], 1).astype(np.float32)
        grads = [error.sum(keepdims=True), g_w, g_v - g_w[:, None] * v]
        grads[1] += pulled * params[1]
        grads[2] += pulled[:, None] * params[2]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            rate = 0.08 if k < 2 else 0.02
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-10)
    linear, hidden = np.zeros(size, np.float32), np.zeros((size, factors), np.float32)
    linear[used], hidden[used] = params[1], params[2]
    return FactorMachine(float(params[0][0]), linear, hidden)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", **bounds) -> FactorMachine:
    """Fit on a bounded sample (``labelled.SAMPLE_ROWS``, ``SAMPLE_BYTES``) of
    labelled rows that are not held out."""
    return fit(labelled_sample(docs, labels, label_col, id_col, where=~held_out(id_col), **bounds))


def score_toxicity(docs: DataFrame, model: FactorMachine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), one
    row for each row. Null and empty texts get the score of no evidence.
    Columns of these names are replaced; nothing is shuffled."""
    rows = docs.drop("score", "predicted")

    def run(batches):
        for part in slices(batches, text_col):
            score = model.score(plain(part.column(text_col)))
            columns = {n: part.column(n) for n in part.schema.names}
            more = {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(columns | more)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", score double, predicted int")
