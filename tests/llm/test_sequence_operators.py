"""Prefix trie, SentencePiece and collocations against plain loops and the
tokenizer library, with the odd cases that each operator defines."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from timberflow.llm import collocations as phrases, prefix_trie as trie
from timberflow.llm.queries import op11_prefix_trie, op13_collocations
from timberflow.llm.sentence_pieces import LONG_WORD, MergeRounds, decode_pieces, encode_pieces
from timberflow.session import workspace

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   a  b\n\n c   d", "</s><s> <unk> <0x0A>", "日本 語　 x", "é   q é é\tz", "▁x ▁▁ y", "\x00 a\x00b 🙂🙂",
    "same text here", "same text here", "ORM describe scribe connect namobs", "word " * 30_000, "a" * (LONG_WORD + 7),
    " " * (LONG_WORD + 33) + "x", "日" * (LONG_WORD + 1), "=-" * 300 + "ab" * 300,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(spark, library):
    rows = [(k if k != 7 else None, t, 1, "d", "i") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[3:5], "doc_id bigint, text string, __n int, decoded string, ids string").repartition(3)
    got = sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"]) for r in encode_pieces(docs, MODEL).collect())
    want = [(k or -1, library.encode(t or ""), library.decode(library.encode(t or ""))) for k, t, *_ in rows + rows[3:5]]
    assert got == sorted(want)
    back = decode_pieces(encode_pieces(docs, MODEL, decoded=False), MODEL)
    assert sorted(r["decoded"] for r in back.collect()) == sorted(w[2] for w in want)


def test_random_pieces_equal_the_library(library):
    draw, model = random.Random(3), MergeRounds(MODEL)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    chars = [*"abcAB  \n\t01é▁日🙂\x00　<>_-", "ing ", "tion", "    ", "scribe", "ORM"]
    texts = ["".join(draw.choice(chars) for _ in range(draw.randrange(60))) for _ in range(1500)]
    texts += ["".join(draw.choice(names)[: draw.randrange(1, 9)] for _ in range(draw.randrange(12))) for _ in range(1500)]
    ids, bounds = model.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == library.encode(texts)
    odd = [0, 1, 2, 3, 35, 195, 172, 230, 151, 166, 259, 28705, 240]  # controls and bytes that make no character
    lists = [[draw.choice(odd) if draw.random() < 0.6 else draw.randrange(32000) for _ in range(draw.randrange(9))] for _ in range(3000)]
    flat = np.array([i for x in lists for i in x])
    assert model.decode(flat, np.cumsum([0, *map(len, lists)])).to_pylist() == library.decode(lists)


def test_store_of_words_starts_anew(library):
    model = MergeRounds(MODEL)
    model.known.limit = 40
    for texts in (["one two three four", "two"], ["five six seven eight nine ten", "one"], ["one two", ""]):
        ids, bounds = model.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == library.encode(texts)


def test_no_documents_and_unknown_ids(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id bigint, text string"), MODEL).count() == 0
    with pytest.raises(ValueError):
        MergeRounds(MODEL).decode(np.array([32000]), np.array([0, 1]))


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [v[1:] for v in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = turns.get(first, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k], saved[k] = sum(leaves[b] for b in below[k]) or 1, own + sum(saved[b] for b in below[k])
        ends = ",".join(str(c) for c in members[k] if len(built[c]) == len(k))
        parent = members[k[:-1]][0] if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((members[k][0], len(k), parent, len(members[k]), len(below[k]), leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def trie_of(spark, rows, folder):
    schema = "conv_id bigint, turn bigint, role string, text string, digest string, position int, words int"
    spark.createDataFrame([(*r, "d", 1, 1) for r in rows], schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted((tuple(r) for r in op11_prefix_trie(spark, folder).collect()), key=repr)


def test_trie_equals_loop(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_BITS", 2)  # many runs of ids per node
    monkeypatch.setattr(trie, "HOT_SHARE", 20)  # some parents are sent to all tasks, others joined
    draw = random.Random(5)
    rows = []
    for c in [*range(-45, 90), 2**62, 10**12]:
        for t in range(draw.randrange(0, 7)):
            rows.append((c, t if t else draw.choice([None, 0]), draw.choice(["user", "bot", None]), draw.choice(["a b", "", None, "a  b\tc", "ab"])))
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(5)]  # a hot group of copies
    rows += [(c, 0, "user", "hi") for c in range(300, 340)] + [(300, 0, "user", "hi")] * 2  # ties and repeated rows
    rows += [(None, 0, "user", "x"), (7, 1, "user", "long " * 50_000), (2**63 - 1, 0, "u", "v"), (400, None, None, None)]
    assert trie_of(spark, rows, workspace(spark, "trie-test")) == plain_trie(rows)


@pytest.mark.parametrize("tail", [0, 1 << 17])
def test_deep_conversations(spark, monkeypatch, tail):
    """The deepest turns give the same nodes in one round and round by round."""
    monkeypatch.setattr(trie, "TAIL_TURNS", tail)
    rows = [(c, t, "user", f"step {t}" if t < cut else str(c)) for c, n, cut in ((41, 22, 99), (42, 22, 99), (44, 17, 15), (45, 19, 8)) for t in range(n)]
    rows += [(c, t, "user", f"step {t}") for c in range(60, 260) for t in range(4)]
    assert trie_of(spark, rows, workspace(spark, "trie-test")) == plain_trie(rows)


def test_trie_without_turns(spark):
    assert trie_of(spark, [], workspace(spark, "trie-test")) == []
    only = spark.createDataFrame([(3, []), (1, None)], "conv_id bigint, turns array<struct<digest:binary,words:bigint>>")
    assert [tuple(r) for r in trie.prefix_trie(only).collect()] == [
        (1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())
    ]


FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, first):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            counts["und" if lang is None else lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if len(k) == 1)
        found = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        inside = {k[i:j] for k, v in found.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and v >= f[k[i:j]]}
        kept = []
        for k, a in found.items():
            if k not in inside:
                score, cut = min((1000 * a * n // (f[k[:x]] * f[k[x:]]), x) for x in range(1, len(k)))
                kept.append((-score, -a, " ".join(k).encode(), f[k[:cut]], f[k[cut:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def phrase_rows():
    draw = random.Random(9)
    letters = [*"abcdef", "É", "é", "New", "york", "日本"]
    text = lambda n: "".join(draw.choice(letters) + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(n))
    rows = [(draw.choice(["en", "fr", None, "und"]), text(draw.randrange(40))) for _ in range(150)]
    rows += [("en", "one phrase that always stands whole")] * 12 + [("en", None), ("fr", ""), (None, "!?"), ("de", "x " * 40_000)]
    return rows


@pytest.mark.parametrize("few", [False, True])
def test_phrases_equal_loop(spark, monkeypatch, few):
    if few:  # a saturated filter and fingerprints of 8 bits, equal for many texts, change nothing
        monkeypatch.setattr(phrases, "FILTER_BITS", 64)
        monkeypatch.setattr(phrases, "mix", lambda h: h & np.uint64(255))
        monkeypatch.setattr(phrases, "SLICE", 400)
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "f", 1) for r in rows], "lang string, text string, phrase string, size int").repartition(4)
    found = phrases.collocations(docs, least=6, first=40)
    assert sorted(tuple(r) for r in found.collect()) == plain_phrases(rows, 6, 40)


def test_phrase_products_beyond_64_bits(spark):
    n = 10**12
    wide = phrases.scored(
        spark.createDataFrame([(n, 3 * n, 2 * n, 10**6 * n)], "a bigint, l bigint, r bigint, n bigint")
    ).first()["score"]
    assert wide == 1000 * n * 10**6 * n // (6 * n * n)


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", " .,"), ("en", None)], "lang string, text string")).count() == 0


def test_registered_queries_have_the_contract_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert op11_prefix_trie(spark, folder).columns[:4] == ["conv_id", "depth", "parent_conv_id", "n_convs"]
    assert op13_collocations(spark, folder).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_row_of_runs_holds_two_megabytes_of_text_at_most(spark):
    docs = spark.createDataFrame([("ab cd " * 170_000, "en")] * 5, "text string, lang string").coalesce(1)
    sizes = [r.n for r in phrases.token_runs(docs, "text", "lang").select("n").collect()]
    assert sum(sizes) == 5 * 340_000 and max(sizes) * 3 <= 2 << 20
