"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, number of tokens).  Texts whose
white space alone differs count the same tokens and share a digest.  A run joins the digests of its
documents to the cache, encodes one text of each digest that is missing, and appends those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.tables import raw_texts, slices, text_only, written
from keysift.llm.vocab import digest, shipped, word_encoder

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens of each row's ``text``, beside its ``content`` digest."""
    vocabulary = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary.value)
        for part in slices(batches):
            counts = pa.array(encoder.counts(raw_texts(part)), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("content"), counts], names=["content", "n_tokens"])

    return docs.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def stored(docs: DataFrame, cache_path: str) -> DataFrame:
    """The cache's rows; none if nothing was ever stored."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document by the JSON tokenizer ``path``.

    Null and empty texts have no tokens.  Repeated rows give repeated results and are encoded once
    (rows alike in ``doc_id`` too may be encoded more than once, and are stored once).  A cache that
    holds a digest twice, from two runs at a time, is read as if it held it once.
    """
    tokenizer = digest(path)
    # The library drops white space between words whatever its amount; nothing else may be folded.
    normal = F.trim(F.regexp_replace("text", r"[ \t-\r]+", " "))
    texts = text_only(docs).withColumn("content", F.sha2(normal, 256))
    keys = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token-keys")

    known = stored(docs, cache_path).where(F.col("tokenizer") == tokenizer).select("content", "n_tokens").dropDuplicates(["content"])
    chosen = keys.groupBy("content").agg(F.min("doc_id").alias("chosen")).join(known, "content", "left_anti")
    chosen = chosen.withColumnRenamed("content", "wanted")
    # Joined by content and id, so that a text that a third of all rows share is dealt out by id.
    same = (F.col("content") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("chosen"))
    misses = counted(texts.join(chosen, same, "left_semi"), path)
    fresh = misses.dropDuplicates(["content"]).select("content", F.lit(tokenizer).alias("tokenizer"), "n_tokens")
    fresh.write.mode("append").parquet(cache_path)

    known = stored(docs, cache_path).where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keys.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
