"""Token counts, BPE, token files, quality and toxicity against plain loops and
the tokenizer library, with the odd cases that each operator defines."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberflow.llm import quality, toxicity
from timberflow.llm.bpe import PairIndexBpe, decode_ids, encode_texts
from timberflow.llm.chunks import ChunkEncoder
from timberflow.llm.labelled import Sample, labelled_sample
from timberflow.llm.simple8b import pack, unpack
from timberflow.llm.texts import plain, words
from timberflow.llm.token_counts import cache_folder, count_tokens, read_cache
from timberflow.llm.token_files import TokenFile, read_token_files, write_token_files
from timberflow.session import workspace

FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE, WORD = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(BYTE), reason="no tokenizer files")

TEXTS = [
    None, "", "   ", "a  b\n\n c   d", "x<|endoftext|> y <|startoftext|>z's", "日本 語　 x", "é   q é é\tz",
    "it's  they'll\u0085 x", "\x1c a\x1f b", "aaaaaaaaaaaa aaaa İ ẞ Σς ΑΣ", "don't.  It'S a'b'c 's 'll. ..x",
    "é. á's", "\x00 a\x00b 🙂🙂", "same text here", "same text here", "word " * 30_000,
]
SCHEMA = "doc_id bigint, text string, id string, key int, score string, n_tokens string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 7 else None, t, "i", 1, "s", "n", "k") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[3:5], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def ids_of(library, path, text):
    return library[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_ids_of_whole_texts(library, path):
    ids, bounds = ChunkEncoder(path).encode(plain(pa.array(TEXTS)))
    for k, text in enumerate(TEXTS):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(library, path, text)


def test_sentencepiece_counts_whole_texts():
    model = ChunkEncoder(f"{FOLDER}/piece_bpe_32k.model")
    want = [len(model.model.encode(t or "")) for t in TEXTS]
    assert model.counts(plain(pa.array(TEXTS))).tolist() == want


def test_token_counts_and_cache(spark, docs, library):
    path = workspace(spark, "cache")
    rows = count_tokens(docs, BYTE, path).collect()
    assert len(rows) == docs.count()
    for row in rows:
        if row["doc_id"] is not None:
            text = TEXTS[row["doc_id"]] or ""
            assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), len(ids_of(library, BYTE, text)))
            assert row["over_limit"] == (row["n_tokens"] > 1024)
    stored = read_cache(spark, path).count()
    assert stored == len({t or "" for t in TEXTS})
    again = count_tokens(docs, BYTE, path)
    assert sorted(again.collect(), key=str) == sorted(rows, key=str)
    assert read_cache(spark, path).count() == stored  # all hits: nothing appended
    count_tokens(docs, WORD, path).count()
    assert read_cache(spark, path).count() == 2 * stored  # another tokenizer has its own counts
    assert count_tokens(docs.limit(0), BYTE, workspace(spark, "cache")).count() == 0
    few = count_tokens(docs.filter("doc_id < 5"), BYTE, path)  # a cache larger than the table
    assert sorted(few.collect(), key=str) == sorted((r for r in rows if r["doc_id"] is not None and r["doc_id"] < 5), key=str)


def test_cache_folder_is_found_again(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = cache_folder(spark, "counts"), cache_folder(spark, "counts")
    if shared:
        assert first == second == f"{shared.rstrip('/')}/counts"
    else:
        assert first != second  # without a shared folder a new one each time


def test_pair_index_equals_the_library(spark, docs, library):
    model = PairIndexBpe(WORD)
    ids, bounds = model.encode(plain(pa.array(TEXTS)))
    for k, text in enumerate(TEXTS):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(library, WORD, text)
    rows = encode_texts(docs, WORD).collect()
    assert len(rows) == docs.count()
    for row in rows:
        if row["doc_id"] is not None:
            want = ids_of(library, WORD, TEXTS[row["doc_id"]])
            assert row["ids"] == want
            assert row["decoded"] == library[WORD].decode(want, skip_special_tokens=False)
    coded = encode_texts(docs, WORD, decoded=False)
    assert {(r["doc_id"], r["decoded"]) for r in decode_ids(coded, WORD).collect()} == {(r["doc_id"], r["decoded"]) for r in rows}
    assert encode_texts(docs.limit(0), WORD).count() == 0


def test_pair_index_on_equal_symbols(library):
    model = PairIndexBpe(WORD)
    texts = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["ll" * 9 + "l"]
    ids, bounds = model.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == ids_of(library, WORD, text)


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    cases = [[], [0], [2**64 - 1], [2**60, 15, 2**60 - 1, 0, 2**63 + 15], [0] * 1000, [1] * 61, list(range(300))]
    cases += [rng.integers(0, 1 << b, 5000).tolist() for b in (1, 3, 8, 16, 31, 45, 62)]
    for case in cases:
        values = np.array(case, np.uint64)
        assert (unpack(pack(values), len(values)) == values).all()
    assert len(pack(np.zeros(2400, np.uint64))) == 10
    assert len(pack(np.full(600, 7, np.uint64))) == 30


def test_token_files(spark, docs, library):
    folder = workspace(spark, "files")
    manifest = write_token_files(docs, BYTE, folder, partitions=4)
    rows = read_token_files(spark, folder, manifest).orderBy("start").collect()
    assert len(rows) == docs.count()
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for row in rows:
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert row["start"] == at and ids[-1] == 0
        at += len(ids)
        if row["doc_id"] is not None:
            assert ids[:-1] == ids_of(library, BYTE, TEXTS[row["doc_id"]])
    assert at == manifest.agg(F.sum("n_tokens")).first()[0]
    again = workspace(spark, "files")
    write_token_files(docs.repartition(5), BYTE, again, partitions=4)
    read = lambda f: {r["path"].split("/")[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").load(f).collect()}
    first = read(folder)
    assert first and first == read(again)  # the same rows give the same files
    # a tiny bound gives several files per range and the same documents
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rolled = workspace(spark, "files")
        files = write_token_files(docs, BYTE, rolled, partitions=2, file_ids=1)
        assert files.count() > 4 and files.agg(F.max("n_docs")).first()[0] <= 2
        assert read_token_files(spark, rolled, files).orderBy("start").collect() == rows
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    file = TokenFile(next(iter(first.values())))
    assert (file.ids(1, 3) == file.ids(0, file.n_ids)[1:3]).all()
    empty = workspace(spark, "files")
    assert read_token_files(spark, empty, write_token_files(docs.limit(0), BYTE, empty)).count() == 0


def test_quality_counts_against_a_loop(spark, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    more = ["a\nb\na\n a\n\n\na", "x y z w v u t s " * 3 + "end", "#1 $2 <b> | & % *", "ünï cödé x \x0b y", "one two"]
    texts = TEXTS + more
    counts = quality.rule_counts(plain(pa.array(texts)), words(plain(pa.array(texts))))
    for k, text in enumerate(texts):
        text = text or ""
        found, seen, dup = word.findall(text), set(), 0
        for line in text.split("\n"):
            dup += bool(word.search(line)) and line in seen
            seen.add(line)
        grams = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
        covered = {j for i in range(len(found) - 7) if grams[tuple(found[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert tuple(int(counts[c][k]) for c in quality.RULES) == want
    model = quality.fit(labelled_sample(docs.limit(0), docs.limit(0).withColumn("quality", F.lit(1)), "quality"))
    judged = quality.judge_quality(docs, model)
    assert judged.count() == docs.count() and "key" in judged.columns
    assert judged.filter("text = '' AND (n_words <> 0 OR NOT base_failed OR kept)").count() == 0
    assert quality.judge_quality(docs.limit(0), model).count() == 0


def test_quality_model_separates_junk(spark):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for k in range(400):
        text = rng.choice(vocab, 60).tolist()
        rows.append((k, " ".join(w + "$$$" for w in text) if k % 4 == 0 else " ".join(text), int(k % 4 > 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.train(df, df.select("doc_id", "quality"))
    judged = quality.judge_quality(df, model).select("doc_id", "quality", "kept").collect()
    assert sum(r["kept"] == (r["doc_id"] % 4 > 0) for r in judged) >= 396
    assert all(0 <= r["quality"] <= 1 for r in judged)


def test_toxicity_learns_words_and_pairs(spark, docs):
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("etaoinshr"), rng.integers(3, 8))) for _ in range(300)]
    rows = []
    for k in range(1200):
        text, toxic = rng.choice(vocab, 40).tolist(), k % 6 == 0
        # each word alone is harmless, both together are not
        text += ["zorgle", "mibfen"] if toxic else [["zorgle"], ["mibfen"], []][k % 3]
        rng.shuffle(text)
        rows.append((k, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"))
    scored = toxicity.score_toxicity(df.withColumn("held", toxicity.held_out()), model).filter("held").collect()
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in scored} == {0}
    assert sum(r["predicted"] == r["toxic"] for r in scored) >= 0.97 * len(scored)
    odd = toxicity.score_toxicity(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert len({r["score"] for r in odd if not (r["text"] or "").strip()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    none = toxicity.train(docs.limit(0), df.select("doc_id", "toxic"))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}


def test_toxicity_learns_what_no_single_word_shows():
    rng = np.random.default_rng(1)
    vocab = ["".join(rng.choice(list("etaoinshr"), rng.integers(3, 8))) for _ in range(300)]
    texts, labels = [], []
    for k in range(1600):
        text, toxic = rng.choice(vocab, 40).tolist(), k % 2 == 0
        # both words or none are toxic, one alone is not: each is in half of the texts of either label
        text += ([["zorgle", "mibfen"], []] if toxic else [["zorgle"], ["mibfen"]])[k // 2 % 2]
        if k % 160 == 0:
            text.append("qwyxavu")  # in 10 toxic texts and no other
        rng.shuffle(text)
        texts.append(" ".join(text))
        labels.append(int(toxic))
    y = np.array(labels)
    model = toxicity.fit(Sample(pa.array(texts[:1200]), y[:1200], np.ones(1200), np.zeros(1200)))
    assert ((model.score(pa.array(texts[1200:])) >= 0.5) == y[1200:]).mean() >= 0.9  # 0.5 when only telling words are learnt
    with_insult, without = model.score(pa.array(["zorgle qwyxavu", "zorgle"]))
    assert with_insult > without


def test_sample_bounds(spark):
    rows = [(k, "w" * 100, k % 2) for k in range(300)] + [(None, "x", 1), (7, "w" * 100, None), (3, "w" * 100, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    sample = labelled_sample(df.select("doc_id", "text"), df.select("doc_id", "y"), "y", rows=100, size=4_000)
    assert len(sample.labels) == 40 and 0 < sample.labels.mean() < 1
    assert abs((sample.weights * sample.labels).sum() / sample.weights.sum() - 0.5) < 0.02


def test_digests_of_a_known_text(spark):
    row = encode_texts(spark.createDataFrame([(1, "Hello, World!")], "doc_id bigint, text string"), WORD).first()
    assert hashlib.sha256(row["decoded"].encode()).hexdigest() == hashlib.sha256(b"hello</w> ,</w> world</w> !</w>").hexdigest()


def test_decoding_holds_little_beside_its_texts():
    import tracemalloc

    import numpy as np
    import public_tokenizers
    from timberflow.llm.bpe import pair_index

    model = pair_index(public_tokenizers.path("word_bpe_49k.json"))
    words = sorted(model.vocab.values())[:1000]
    ids = np.array(words * 300, np.int64)
    bounds = np.array([0, 0, 3, 100_000, len(ids), len(ids)], np.int64)
    name = {i: n for n, i in model.vocab.items()}
    expected = [" ".join(name[i] for i in ids[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    tracemalloc.start()
    texts = model.decode(ids, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert texts.to_pylist() == expected
    assert peak < 16 * len(ids)  # a few numbers an id, none a byte of text
