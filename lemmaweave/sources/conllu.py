"""CoNLL-U files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sent_id and the ten fields of each plain token; multiword and empty nodes are left out. The lemma of
    OrigLemma in misc overrides the column. A sentence without an id is named by its place."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    new = (F.col("value") == "").cast("int")
    named = F.nullif(F.regexp_extract("value", r"^#\s*sent_id\s*=\s*(\S.*?)\s*$", 1), F.lit(""))
    df = lines.withColumn("ordinal", F.sum(new).over(w)).withColumn("name", F.last(named, ignorenulls=True).over(Window.partitionBy("file", "ordinal").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    f = F.split("value", "\t")
    rows = df.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("file", F.coalesce("name", F.concat(F.lit("ordinal:"), "ordinal")).alias("sent_id"), (F.size(f) == 10).alias("well_formed"), *[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])
    original = F.nullif(F.regexp_extract("misc", r"(?:^|\|)OrigLemma=([^|]*)", 1), F.lit(""))
    return rows.where(~F.col("id").rlike("[-.]")).withColumn("lemma", F.coalesce(original, "lemma"))
