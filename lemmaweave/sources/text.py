"""Plain text in, JSON lines and tab-separated text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text(spark: SparkSession, path: str, *, whole: bool = True) -> DataFrame:
    """doc_id (the file's path, or the line's place in it) and text of each file, or line."""
    if whole:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    return spark.read.text(path).select(F.concat_ws(":", F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("doc_id"), F.col("value").alias("text"))


@F.udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("at", T.LongType())]))
def _valid_prefix(content):  # noqa: ANN001, ANN202
    """What a faulty text holds before its first fault, and the byte where that is."""
    raw = bytes(content)
    try:
        return raw.decode(), None
    except UnicodeDecodeError as e:
        return raw[: e.start].decode(), e.start


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text and error of each file. Of a file that is not UTF-8 the text before the fault is kept, and the error says where it is."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = raw.where(valid).select("doc_id", F.col("content").cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    bad = raw.where(~valid).withColumn("r", _valid_prefix("content"))
    return good.unionByName(bad.select("doc_id", F.col("r.text").alias("text"), F.concat(F.lit("invalid UTF-8 at byte "), F.col("r.at")).alias("error")))


def write_jsonl(analyses: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One object a row; never over what is there, unless asked."""
    analyses.write.mode(mode).json(path)


def text_lines(analyses: DataFrame) -> DataFrame:
    """value: lemmas, morphemes and rules of each analysis, tab-separated."""
    join = lambda c, f: F.concat_ws(" + ", F.transform(c, lambda x: x[f]))
    return analyses.select(F.concat_ws("\t", join("lemmas", "text"), join("morphemes", "form"), F.concat_ws(", ", "rules")).alias("value"))


def token_lines(tokens: DataFrame) -> DataFrame:
    """value: span, quoted surface and lemmas of each token."""
    lemmas = F.concat_ws(" | ", F.col("lemma_strings")) if "lemma_strings" in tokens.columns else F.lit("")
    return tokens.select(F.concat(F.col("start"), F.lit(".."), F.col("end"), F.lit('\t"'), F.col("surface"), F.lit('"\t'), lemmas).alias("value"))


def register_http(spark: SparkSession) -> None:
    """Makes spark.read.format("lemmaweave_http").option("urls", "one per line") read texts over HTTP: doc_id (the URL), text and error, a partition a URL."""
    from .http import HttpTexts

    spark.dataSource.register(HttpTexts)
