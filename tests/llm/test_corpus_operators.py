"""URL rules, decontamination, WARC, near duplicates, language and the pipeline
against brute force and planted cases."""

import random
from collections import defaultdict
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from timberflow.llm import decontaminate, language, near_dedup, url_filter, warc
from timberflow.llm.components import components
from timberflow.llm.queries import RULES
from timberflow.session import workspace


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def vocab():
    rng = random.Random(1)
    return ["".join(rng.choice("bcdfghaeiou") for _ in range(rng.randint(3, 9))) for _ in range(3000)]


# URL filter


def reference_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "://", "http://WWW.Example.COM/en/x?a=/b#c", "https://example.com/en/", "https://example.com/en",
        "http://notexample.com/en/1", "http://a.example.net/es/9", "http://x.net/fr/", "http://x.net", "http://x.net?q=/fr/", "http://com/",
        "http://org.example/?a=1&b=2", "ftp://ÄB.com/é/#x", "http://a.net/fr/1\nx", "http://" + "a" * 5000 + ".org/" + "b/" * 500, "http://a..com/x", "a://b://c.com/x",
    ]
    rows = [(k, u, "x", 1) for k, u in enumerate(urls)] + [(3, urls[3], "x", 1), (None, "http://q.com/", "x", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, label int")
    got = url_filter.filter_urls(pages, RULES).collect()
    assert len(got) == len(rows)
    for row in got:
        if row["page_id"] is not None:
            host, path, rule, verdict = reference_rule(urls[row["page_id"]])
            assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
            assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_url_trees_follow_the_labels(spark):
    rows = [(k, f"http://{'a' if k % 2 else 'b'}{k}.org/{'9' * 12 if k % 2 else 'news'}/{k}") for k in range(400)]
    rules = [url_filter.Rule("block" if k % 2 else "allow", urlsplit(u).netloc, "/") for k, u in rows[:200]]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in got) >= 396
    assert sum(r["rule"] is None for r in got) == 200


# Decontamination


def test_decontamination_finds_copies_and_paraphrases(spark, vocab):
    rng = random.Random(2)
    items = [sentence(rng, rng.randint(12, 90), vocab) for _ in range(30)]
    docs, want = [], set()
    for k in range(240):
        text = sentence(rng, rng.randint(0, 300), vocab).split()
        if k % 4 == 0:
            i = rng.randrange(30)
            part = items[i].split()
            if k % 8 == 0:  # every seventh word replaced
                part = [rng.choice(vocab) if j % 7 == 3 else w for j, w in enumerate(part)]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in part]
            want.add((k, i))
        docs.append((k, " ".join(text), "m", 3))
    docs += [(900, None, "m", 3), (901, "", "m", 3), (None, items[0], "m", 3)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, matches string, term int").repartition(4)
    bench = spark.createDataFrame([*enumerate(items), (None, items[0]), (77, None), (78, "")], "item_id bigint, text string")
    space = decontaminate.fit_space(frame)
    marked = decontaminate.mark_contaminated(frame, bench, space)
    assert marked.count() == len(docs) and "term" in marked.columns
    got = {(r["doc_id"], r["i"]) for r in marked.select("doc_id", F.explode("matches.item").alias("i")).collect()}
    assert got - {(None, 0)} == want and (None, 0) in got
    assert decontaminate.fit_space(frame.limit(0)) is None
    assert decontaminate.mark_contaminated(frame.limit(0), bench, space).count() == 0
    assert decontaminate.mark_contaminated(frame, bench.limit(0), space).filter("size(matches) > 0").count() == 0


def test_short_items_are_found_at_every_offset(vocab):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(31)
    vectors = np.random.default_rng(31).normal(size=(decontaminate.TERMS, 40)).astype(np.float32)
    space = decontaminate.Space(vectors)
    for n in (1, 2, 3, 6, 7, 8, 9, 12, 16):
        item = sentence(rng, n, vocab[:1000]).split()
        probes = decontaminate._probes([5], [" ".join(item)], [None], space)
        texts = []
        for offset in range(8):
            words = sentence(rng, 48, vocab[1000:]).split()
            words[16 + offset : 16 + offset] = item
            texts.append(" ".join(words))
        split = item[: n // 2]  # over the end of one text and the start of the next
        texts += [sentence(rng, 20, vocab[1000:]) + " " + " ".join(split), " ".join(item[n // 2 :]) + " " + sentence(rng, 20, vocab[1000:])]
        got = decontaminate._matches(pa.array(texts), space, probes)
        assert {r for r, _ in got} - {9} == set(range(8)), n
        assert (9 in {r for r, _ in got}) == (n == 1)
        assert all(share == 1.0 for share, _ in got.values())


def test_answer_decides_a_loose_match(vocab):
    words = tuple(vocab[:20])
    item = decontaminate.Item(0, words, words[-4:])
    head = list(words[:9]) + ["x"] * 4
    assert decontaminate._confirmed(item, head + list(words[-4:]), 0) >= decontaminate.LIKELY
    assert decontaminate._confirmed(item, list(words[:13]), 0) == 0.0
    assert decontaminate.common(("a", "b", "c", "a"), ["a", "x", "c", "a", "b"]) == 3


# WARC


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 300_000, "same " * 40, "same " * 40, "same " * 40]
    rows = [(k, f"http://h/{k}", t, "u", 1) for k, t in enumerate(html)] + [(20, None, "other\nline", "u", 1), (None, "http://n", "same " * 40, "u", 1), (6, "http://h/6", "same " * 40, "u", 1)]
    rows += [(k, f"http://h/{k}", f"<html><body>{'common words ' * 20}{k}</body></html>", "u", 1) for k in range(30, 80)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, last string, sha int").repartition(3)
    folder = workspace(spark, "warc")
    manifest = warc.write_warc(pages, folder)
    got = warc.read_warc(spark, folder, payloads=True).collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("n_records")).first()[0]
    largest = defaultdict(int)
    for page, _, text, *_ in rows:
        largest[text or ""] = max(largest[text or ""], page or 0)
    source = {(r[0], r[1]): r[2] or "" for r in rows}
    for row in got:
        text = source[row["page_id"], row["url"]]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(text.encode()), warc.payload_digest(text.encode()))
        last = largest[text]
        assert (row["record_type"], row["refers_to"]) == (("response", None) if row["page_id"] == last else ("revisit", last))
        assert row["payload"] is None if row["record_type"] == "revisit" else bytes(row["payload"]).decode() == text
    head = spark.read.format("binaryFile").load(folder).select("content").first()[0]
    assert bytes(head[:4]) == warc.SKIPPABLE
    rolled = workspace(spark, "warc")
    files = warc.write_warc(pages, rolled, file_bytes=1)
    assert files.count() == len(rows) and files.agg(F.max("n_records")).first()[0] == 1
    assert sorted(warc.read_warc(spark, rolled, payloads=True).collect(), key=str) == sorted(got, key=str)
    size = warc.write_warc(pages, workspace(spark, "warc"), smallest=1000)
    assert size.count() > 0
    assert warc.write_warc(pages.limit(0), workspace(spark, "warc")).count() == 0


# Near duplicates


def brute_force(docs, size, percent):
    sets = {}
    for k, text in docs:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            shared = len(x & y)
            if shared and 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, vocab, size, percent):
    rng = random.Random(size)
    docs = [(k, sentence(rng, rng.randint(0, 12), vocab)) for k in range(40)]
    base = [sentence(rng, 120, vocab).split() for _ in range(4)]
    for k in range(40, 240):  # groups at all distances from their base, chains among them
        words = list(base[k % 4])
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(120)] = rng.choice(vocab)
        docs.append((k, " ".join(words)))
    docs += [(300, None), (301, "  "), (302, docs[50][1].upper())]
    want = brute_force(docs, size, percent)
    frame = spark.createDataFrame([(*d, "x", 1) for d in [*docs, (None, docs[50][1]), docs[60]]], "doc_id bigint, text string, node string, n int")
    got = near_dedup.near_duplicates(frame, size=size, percent=percent).collect()
    assert len(got) == len(docs) + 2
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"]) == want[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["component_id"])
    left = near_dedup.drop_near_duplicates(frame, size=size, percent=percent)
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == sorted({c for _, c in want.values()})
    assert left.columns == frame.columns and left.filter("doc_id IS NULL").count() == 1
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_blocks_settle_what_hubs_leave(spark, vocab, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(4)
    base, docs = sentence(rng, 150, vocab).split(), []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(150)] = rng.choice(vocab)
        docs.append((k, " ".join(words)))
    want = brute_force(docs, 3, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), size=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {k: c for k, (_, c) in want.items()}


def test_documents_are_dropped_by_id_and_text(spark, vocab):
    rng = random.Random(5)
    a, b, c = (sentence(rng, 80, vocab) for _ in range(3))
    near = lambda text: text + " tail"
    rows = [(1, a), (5, near(a)), (5, b), (7, c), (7, near(c)), (8, near(c)), (9, None), (9, ""), (9, ""), (5, b)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = sorted((r["doc_id"], r["text"] or "") for r in near_dedup.drop_near_duplicates(frame).collect())
    one = [x for x in left if x[0] == 7]
    assert len(one) == 1 and one[0][1] in (c, near(c))
    assert [x for x in left if x[0] != 7] == [(1, a), (5, b), (9, ""), (9, "")]


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(5, 5), (None, 3)]
    root = {n: n for n in range(300)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a int, b int")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["comp"] for r in got} == {n: find(n) for a, b in links if a is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_pruning_keeps_the_miss_probability():
    plan = near_dedup.bands(85)
    assert (1 - 0.85**plan.width) ** plan.number <= near_dedup.MISS
    assert plan.number <= 24 and (plan.least[1:] >= plan.least[:-1]).all()
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 30, (4000, plan.size), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.86, a, a + np.uint32(1))
    kept, _ = plan.likely(a, b)
    assert len(kept) >= 3990
    far, _ = plan.likely(a, np.where(rng.random(a.shape) < 0.5, a, a + np.uint32(1)))
    assert len(far) <= 4


# Language


def test_language_fuses_evidence(spark):
    rng = random.Random(8)
    letters = {"aa": "abcde", "bb": "mnopq", "cc": "vwxyz"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    docs = spark.createDataFrame([(k, text(lang, 60), lang) for k, lang in enumerate(list(letters) * 20)] + [(99, None, "aa"), (98, "x", None)], "doc_id bigint, text string, lang string")
    model = language.train_text(docs)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(k, f"http://{lang}.site.org/{lang}/{k}", f'<html lang="{lang}"><body>{text(lang, 30)}</body></html>') for k, lang in enumerate(list(letters) * 10)]
    rows += [(100, "http://bb.site.org/x", None), (101, None, None), (102, "http://new.org/cc/1", ""), (103, "http://aa.site.org/", f"<script>{text('cc', 90)}</script><p>{text('aa', 9)}</p>"), (104, "http://q.org/", '<html lang="bb"></html>'), (105, "http://q.org/", '<html lang="zz"><p>' + text("cc", 20))]
    pages = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (None, *rows[0][1:]), rows[1]]], "page_id bigint, url string, html string, host string, best int")
    got = {r["page_id"]: r for r in language.identify(pages, model).collect()}
    assert language.identify(pages, model).count() == len(rows) + 2
    for k, lang in enumerate(list(letters) * 10):
        assert got[k]["lang"] == lang and got[k]["declared"] == lang and got[k]["probability"] > 0.9
    assert got[100]["lang"] == "bb" and got[100]["text_lang"] is None  # from the host
    assert got[102]["lang"] == "cc" and got[103]["lang"] == "aa" and got[104]["lang"] == "bb" and got[105]["lang"] == "cc"
    assert got[101]["lang"] in letters
    assert language.identify(pages.limit(0), model).count() == 0
    assert language.train_text(docs.limit(0)).languages == ["und"]


def test_rare_languages_are_answered(spark):
    rng = random.Random(18)
    letters = {"aa": "abcde", "bb": "mnopq", "cc": "vwxyz"}
    text = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    labels = ["aa", "bb"] * 1500 + ["cc"] * 2  # below a thousandth
    docs = spark.createDataFrame([(text(lang, 12 if lang != "cc" else 300), lang) for lang in labels], "text string, lang string")
    model = language.train_text(docs)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(k, f"http://h{k}.org/", f'<html lang="{lang}"><p>{text(lang, 30)}</p>') for k, lang in enumerate(list(letters) * 5)]
    got = {r["page_id"]: r for r in language.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()}
    for k, lang in enumerate(list(letters) * 5):
        assert got[k]["lang"] == got[k]["declared"] == lang


def test_languages_in_blocks_score_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    model = language.TextModel(["a", "b", "c", "d", "e"], rng.normal(size=(1 << language.BITS, 5)))
    texts = pa.array(["one two three", "", "two two"])
    whole = model.score(texts)[0]
    monkeypatch.setattr(language, "BLOCK", 2)
    assert np.allclose(whole, model.score(texts)[0])


# Pipeline


def test_pipeline_stages(spark, vocab, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows, labels = [], []
    for k in range(300):
        words = sentence(rng, 80, vocab).split()
        junk, toxic = k % 10 == 1, k % 10 == 2
        if junk:
            words = [w + "$$$" for w in words]
        if toxic:
            words[20:20] = ["zorgle", "mibfen"]
        rows.append((k, " ".join(words), "en", "s", 1, "mine"))
        if k < 250:
            labels.append((k, int(not junk), int(toxic)))
    item = sentence(rng, 40, vocab)
    rows += [(500, rows[3][1], "en", "s", 1, "mine"), (501, rows[4][1] + " tail", "en", "s", 1, "mine"), (502, sentence(rng, 60, vocab) + " " + item, "en", "s", 1, "mine"), (503, None, None, None, None, None), (None, sentence(rng, 60, vocab), "en", "s", 1, "mine")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, kept string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    gone = [set(range(1, 300, 10)) | {503}, set(range(2, 300, 10)), {500, 501}, {502}]
    for (name, stage), drop in zip(corpus_pipeline.STAGES, gone, strict=False):
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in after.select("doc_id").collect()} == before - drop, name
        assert {r["kept"] for r in after.select("kept").collect()} == {"mine"}
        docs = after
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0

