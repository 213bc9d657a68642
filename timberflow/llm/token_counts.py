"""Token counts with a digest cache.

The cache is a table (tokenizer, digest, n_tokens): ``tokenizer`` is the digest
of the tokenizer file, ``digest`` that of the normalised text. Texts are looked
up by digest; one text per missing digest is encoded, and the new counts are
appended.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from timberflow.llm.chunks import digest_of, encoder
from timberflow.llm.texts import plain, slices
from timberflow.session import stored, workspace

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored counts, or None when nothing has been stored yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def cache_folder(spark: SparkSession, name: str) -> str:
    """A folder that later runs find again: ``name`` below the shared
    ``spark.checkpoint.dir``; where that is unset, a new one for this run."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared.rstrip('/')}/{name}" if shared else workspace(spark, name)


def exact(text: Column) -> Column:
    """The normal form that keeps every count: nulls become empty texts."""
    return F.coalesce(text, F.lit(""))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = exact,
    limit: int = 1024,
) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens). Equal texts, repeated ids
    and null ids keep a row each. Other columns are not read. The call encodes
    missing texts and appends their counts before it returns; the cache may
    hold counts of other tokenizers. If two jobs append the same digest, either
    row serves, since a digest and a tokenizer fix the count.

    Text moves only once, and only for missing digests: of each one the row
    with the smallest id is picked on digests alone, so copies of a text, even
    a third of all rows, never meet in a task. Of the cache only the rows of
    this table's digests are grouped.
    """
    spark = docs.sparkSession
    version = digest_of(tokenizer_path)
    text = normalise(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("__id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )
    keyed = stored(keyed, "digests")
    digests = keyed.groupBy("digest").agg(F.min("__id").alias("__id"))
    wanted = digests
    cache = read_cache(spark, cache_path)
    if cache is not None:
        wanted = digests.join(cache.filter(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")
    texts = docs.select(
        F.col(id_col).alias("__id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("__text")
    )
    same = (F.col("t.digest") == F.col("w.digest")) & F.col("t.__id").eqNullSafe(F.col("w.__id"))
    missing = texts.alias("t").join(wanted.alias("w"), same, "left_semi")

    def encode(batches):
        model = encoder(tokenizer_path)
        for part in slices(batches, "__text"):
            counts = model.counts(plain(part.column("__text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts)), part.column("digest"), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    fresh = missing.select("digest", "__text").mapInArrow(encode, CACHE_SCHEMA)
    fresh.dropDuplicates(["digest"]).write.mode("append").parquet(cache_path)
    counts = (
        read_cache(spark, cache_path)
        .filter(F.col("tokenizer") == version)
        .join(digests.select("digest"), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("n_tokens").alias("n_tokens"))
    )
    # a stored side lets the engine split the rows of a frequent text
    counts = stored(counts, "counts")
    return keyed.join(counts, "digest").select(
        F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
