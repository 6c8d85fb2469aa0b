"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path
from .decontaminate import find_contaminated
from .html_text import extract_text
from .lm import score_documents
from .oracle import ORACLES
from .packing import pack_documents
from .quality import judge_quality
from .records import token_records
from .search import search_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .substring import duplicate_factors
from .token_counts import count_tokens
from .vector_codes import compress_vectors
from .warc import archive_pages


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contaminated(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_pages(_read(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_factors(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_records(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), fresh_path(spark, "records"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontaminate, op2_warc, op3_simhash, op4_sharding, op5_packing, op6_token_counts, op7_quality, op8_substring, op9_lm, op10_records, op11_html, op12_search, op13_codes)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
