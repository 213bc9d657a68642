"""Labelled samples, the factorization machine and the pruned benchmark search
on the cases in which they could lose rows."""

import numpy as np
import pyarrow as pa
import pytest

from timberflow.llm import decontaminate, quality, toxicity
from timberflow.llm.labelled import Sample, labelled_sample, word_terms


def documents(spark, n):
    return spark.createDataFrame([(k, f"text {k} of some words") for k in range(n)], "doc_id bigint, text string")


def test_labels_of_other_documents_do_not_count(spark):
    labels = spark.range(60_000).selectExpr("id as doc_id", "int(id % 10 = 0) as toxic")
    sample = labelled_sample(documents(spark, 3000), labels, "toxic", rows=400)
    assert len(sample.labels) == 400 and sample.labels.sum() == 200
    assert sample.weights[sample.labels == 1].sum() / sample.weights.sum() == pytest.approx(0.1)
    few = labelled_sample(documents(spark, 50), labels, "toxic")
    assert len(few.labels) == 50 and few.labels.sum() == 5


def test_one_label_only(spark):
    labels = spark.range(100).selectExpr("id as doc_id", "0 as toxic", "1 as quality")
    docs = documents(spark, 40)
    with pytest.warns(UserWarning, match="nothing tells"):
        model = toxicity.train(docs, labels)
    assert model.score(pa.array(["text 1", ""])).max() < 1e-6
    with pytest.warns(UserWarning, match="nothing tells"):
        sample = labelled_sample(docs, labels, "quality")
    assert quality.fit(sample) is not None


def invented(seed, n, word):
    draw = np.random.default_rng(seed)
    vocab = [f"w{chr(97 + k % 26)}{k * 7919 % 99991:x}q" for k in range(2000)]
    texts = [[vocab[int(j)] for j in draw.zipf(1.3, 40) % 2000] for _ in range(n)]
    return [" ".join(t[:5] + ([word(k)] if word(k) else []) + t[5:]) for k, t in enumerate(texts)]


def test_rare_insults_are_learnt():
    rare = "zurblak quodrix fenmopt gralshy hexvund jimbrot klopzen morwigg nyrthak pellosk".split()
    toxic = invented(1, 500, lambda k: rare[k % 10] if k < 100 else "dumbbozo")  # 10 of 500 texts each
    clean = invented(2, 500, lambda k: None)
    labels = np.repeat([1, 0], 500)
    sample = Sample(pa.array(toxic + clean), labels, np.where(labels == 1, 0.2, 1.8), np.zeros(1000))
    model = toxicity.fit(sample)
    caught = model.score(pa.array(invented(3, 100, lambda k: rare[k % 10]))) >= 0.5
    flagged = model.score(pa.array(invented(4, 300, lambda k: None))) >= 0.5
    assert caught.mean() >= 0.95 and flagged.mean() <= 0.02


def test_score_equals_the_double_sum():
    draw = np.random.default_rng(5)
    size = 1 << toxicity.BITS
    model = toxicity.FactorMachine(
        0.3, draw.normal(0, 0.01, size).astype(np.float32), draw.normal(0, 0.02, (size, 3)).astype(np.float32)
    )
    texts = ["one two two three.", "", "ONE; two", "longer words standing here"]
    for text, score in zip(texts, model.score(pa.array(texts)), strict=True):
        held = sorted({*text.lower().replace(".", " ").replace(";", " ").split()})
        terms = np.concatenate([t.buckets for t in word_terms(pa.array(held, pa.string()), toxicity.BITS, toxicity.SIZES)]).astype(int)
        z = model.bias + sum(float(model.linear[t]) for t in terms)
        for i in range(len(terms)):
            for j in range(i):
                z += float(model.factors[terms[i]].astype(float) @ model.factors[terms[j]].astype(float))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def search_case():
    draw = np.random.default_rng(8)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    line = lambda n: [vocab[int(k)] for k in draw.zipf(1.2, n) % len(vocab)]
    items = [line(n) for n in (8, 9, 12, 16, 17, 24, 40, 64, 65, 150, 300)]
    texts = [line(n) for n in (0, 3, 40, 200, 900, 5000)]
    for item in items:
        for share in (1.0, 0.85, 0.65):  # copies with words left out, at any place
            kept = [w for k, w in enumerate(item) if draw.random() < share or k >= 0.75 * len(item)]
            at = int(draw.integers(0, 30))
            texts.append(line(at) + kept + line(20))
    texts.append(line(100) + items[9][50:] + line(50))  # an item without its first words
    return [" ".join(t) for t in texts], [" ".join(i) for i in items]


def test_pruned_search_finds_what_the_whole_search_finds(spark, monkeypatch):
    texts, items = search_case()
    space = decontaminate.fit_space(spark.createDataFrame([(t,) for t in texts], "text string"))
    probes = decontaminate._probes(list(range(len(items))), items, [None] * len(items), space)
    found = decontaminate._matches(pa.array(texts), space, probes)
    monkeypatch.setattr(decontaminate, "_near", lambda starts, *_: np.arange(len(starts)))
    whole = decontaminate._matches(pa.array(texts), space, probes)
    assert found.keys() == whole.keys() and len(found) >= 25
    for key, (share, cosine) in whole.items():
        assert found[key] == (share, pytest.approx(cosine, abs=1e-5))
    assert (len(texts) - 1, 9) in found


def test_distinct_passage_terms_are_sorted_not_hashed():
    import time

    import numpy as np
    from timberflow.llm.decontaminate import _distinct

    def seconds(of, key):
        began = time.process_time()
        found = of(key)
        return time.process_time() - began, found

    for key in (np.empty(0, np.uint32), np.zeros(3, np.int64), np.array([5, 1, 5, 0], np.uint32)):
        assert _distinct(key.copy()).tolist() == sorted(set(key.tolist()))
    passage = np.repeat(np.arange(40_000), 48)
    key = (passage * 8192 + np.random.default_rng(1).integers(0, 8192, len(passage))).astype(np.uint32)
    hashed, expected = seconds(np.unique, key)
    sorting, found = seconds(_distinct, key.copy())
    assert (found == expected).all() and sorting < hashed
