"""Token counts through a digest cache.

The cache is a Parquet table of (content, tokenizer, n_tokens): the SHA-256 of the normalised content, the
SHA-256 of the tokenizer's file, and the count. Texts are joined to it by their digests; only distinct texts
that it lacks are encoded, and their counts are appended before the join is repeated. The normal form is the
text's UTF-8 bytes, null as empty: the tokenizers in question tell any two different byte strings apart.

The digests that the cache lacks are found first, without texts, and written, so that Spark knows their size: without any, no text is read again; while they fit a
broadcast, the texts stay where they are and only the missing ones go on; beyond that, texts are dealt by (document, digest), behind Spark's runtime filter, which
drops most of the known ones where the missing are few. One document stands for each digest and its id is part of the key, so a text with many copies is no hot key.

Defined cases: null or empty text has 0 tokens; a text of any length is counted whole, in pieces that no token can cross; counts have no ties to break; repeated rows and rows that share an id are each counted;
an empty table gives no rows and leaves the cache as it is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, look_up, narrow
from .tokenize import encoder, slices

LIMIT = 512
CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _cached(docs: DataFrame, cache: str) -> DataFrame:
    spark = docs.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """content and n_tokens of rows (content, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [encoder(tokenizer).counts(some) for some in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *n]))], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(narrow(run), "content string, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and content (the digest) of each document; cache is a path in shared storage."""
    version = tokenizer_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text")).withColumn("content", F.sha2(F.col("text"), 256))
    known = _cached(docs, cache).where(F.col("tokenizer") == version)
    # One document stands for each digest: its id is part of the key, so that the text join has no hot key.
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digests = cut(rows.groupBy("content").agg(F.min(who).alias("who"), F.count(F.lit(1)).alias("n")), "digests")
    missing = cut(digests.select("content", "who").join(known.select("content"), "content", "left_anti"), "missing")
    if not missing.isEmpty():
        texts = rows.withColumn("who", who).join(missing, ["content", "who"], "left_semi")
        # Rows that repeat with the same id and text are encoded alike; one count of each digest is stored.
        fresh = encode_counts(texts, tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
        fresh.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = _cached(docs, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    hot = hot_keys(digests, "content", "n", digests.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    out = look_up(out, counts, "content", hot)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content")
