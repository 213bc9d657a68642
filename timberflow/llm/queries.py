"""Registered queries of the subpackage: thin callers of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from timberflow.llm.bpe import encode_texts
from timberflow.llm import decontaminate, language, prefix_trie, quality, toxicity, warc
from timberflow.llm.collocations import collocations
from timberflow.llm.near_dedup import near_duplicates
from timberflow.llm.sentence_pieces import encode_pieces
from timberflow.llm.token_counts import cache_folder, count_tokens
from timberflow.llm.token_files import read_token_files, write_token_files
from timberflow.llm.url_filter import Rule, filter_urls
from timberflow.plans.registry import table
from timberflow.session import prepare, stored, workspace

BYTE_BPE, WORD_BPE, PIECES = map(
    public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")
)

RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(prepare(spark), sf_dir, "pages"), RULES)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return count_tokens(docs, BYTE_BPE, cache_folder(spark, "token-counts"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(prepare(spark), sf_dir, "documents"), WORD_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(prepare(spark), sf_dir, name) for name in ("documents", "labels"))
    rows = docs.select("doc_id", toxicity.held_out().alias("held_out"), "text")
    return toxicity.score_toxicity(rows, toxicity.train(docs, labels)).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row for each benchmark item found."""
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    space = decontaminate.fit_space(docs)
    marked = decontaminate.mark_contaminated(docs, table(spark, sf_dir, "benchmark"), space)
    return marked.select("doc_id", F.explode("matches").alias("m")).select(
        "doc_id", F.col("m.item").alias("item_id"), F.col("m.share").alias("share"), F.col("m.cosine").alias("cosine")
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(prepare(spark), "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), BYTE_BPE, folder)
    return read_token_files(spark, folder, manifest).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    folder = workspace(spark, "warc")
    if warc.write_warc(pages, folder).isEmpty():
        return spark.createDataFrame([], warc.SCHEMA).drop("url")
    return warc.read_warc(spark, folder).drop("url")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(prepare(spark), sf_dir, "documents"), size=3, percent=85)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text likelihoods come from the labelled documents, the rest from pages."""
    docs, pages = (table(prepare(spark), sf_dir, name) for name in ("documents", "pages"))
    return language.identify(pages, language.train_text(docs))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(prepare(spark), sf_dir, name) for name in ("documents", "labels"))
    rows = docs.select("doc_id", "text")
    return quality.judge_quality(rows, quality.train(docs, labels)).drop("text")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.digested(prefix_trie.ordered_turns(table(prepare(spark), sf_dir, "conversations")))
    return prefix_trie.prefix_trie(prefix_trie.with_heads(stored(turns, "turns")))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(prepare(spark), sf_dir, "documents"), PIECES)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(prepare(spark), sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_token_counts": op2_token_counts,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_near_dedup": op8_near_dedup,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Classes of equal sets, their links by shared shingles, and all that is
#: reachable over them.
_NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE
    WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, any_value(len(sh)) AS n, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS rep, min(b) AS component FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id,
  coalesce(m.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.rep = c.rep"""

#: The digest in base 32: four numbers of 40 bits, eight symbols each.
_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p),
v AS (SELECT *, list_transform(range(4), lambda g: CAST('0x' || substr(h, 10 * g + 1, 10) AS BIGINT)) AS v FROM h)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((v[i // 8 + 1] >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM v"""

#: Nodes are list prefixes; the inner reductions are the bytewise crc32.
_TRIE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, n: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT i.conv_id, 0 AS part, p, r, x FROM i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 20 AND p <= h
  UNION ALL SELECT conv_id, 1, p, r, x FROM i JOIN t USING (conv_id) WHERE p > h),
c AS (SELECT i.conv_id, coalesce(list({'r': r, 'x': x} ORDER BY part, p) FILTER (r IS NOT NULL), []) AS l
  FROM i LEFT JOIN s USING (conv_id) GROUP BY i.conv_id),
m AS (SELECT conv_id, l, unnest(range(len(l) + 1)) AS depth FROM c),
n AS (SELECT l[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(l) = depth), '')) AS ends_sha256
  FROM m GROUP BY ALL),
f AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
  CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(k[depth].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN f USING (k)),
u AS (SELECT k[1:e] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM o) GROUP BY 1)
SELECT o.conv_id, o.depth, a.conv_id AS parent_conv_id, o.n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN u USING (k) LEFT JOIN n a ON o.depth > 0 AND a.k = o.k[1:o.depth - 1]"""

_COLLOCATIONS = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[pos:pos + k - 1] AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, ws, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.ws, a, l.f AS l, r.f AS r, n, cut,
  CAST(1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS BIGINT) AS score
  FROM c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.ws = c.ws[1:cut]
  JOIN f r ON r.lang = c.lang AND r.ws = c.ws[cut + 1:c.k]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT lang, ws[x:x + y - 1] AS ws, f FROM
  (SELECT *, unnest(range(1, k - y + 2)) AS x FROM (SELECT *, unnest(range(2, k)) AS y FROM f WHERE k > 2))),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.ws = b.ws AND 100 * d.f >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM (SELECT *, array_to_string(ws, ' ') AS phrase,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank FROM z)
WHERE rank <= 2000"""

#: The other queries use trained models or tokenizer libraries.
ORACLES: dict[str, str] = {
    "op7_warc": _WARC,
    "op8_near_dedup": _NEAR_DEDUP,
    "op11_prefix_trie": _TRIE,
    "op13_collocations": _COLLOCATIONS,
}
