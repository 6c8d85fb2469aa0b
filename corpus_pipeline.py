"""A training corpus in five stages; each is written as Parquet and read again as the next one's documents.

Defined cases: a document with a null or empty text has no words and fails the quality rules; one with a null id links nothing and loses nothing to others, but is judged, kept and packed
like any; of near copies that with the smallest id stays, and rows equal in id and text stay or go together; rows that share an id are judged each by its own text; texts of any length pass whole; further
columns are carried to the last stage, whatever their names; empty documents give no rows, and without labels, or without a benchmark, the rules that need them reject nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemmaweave.llm.common import fresh_path
from lemmaweave.llm.decontaminate import remove_contaminated
from lemmaweave.llm.jaccard import drop_similar
from lemmaweave.llm.packing import pack_documents
from lemmaweave.llm.quality import keep_quality
from lemmaweave.llm.queries import tokenizer_path
from lemmaweave.llm.substring import dedup_texts


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_texts(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Shingle similarity, log-likelihood ratios and packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
