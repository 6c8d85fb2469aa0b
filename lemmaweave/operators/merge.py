"""Duplicates of an analysis, merged with the union of their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Declaration order of the kinds, for sorting.
LEMMA_KINDS = ("Unclassified", "Nominal", "Predicate", "Copula", "Auxiliary", "Adverbial", "Root")
MORPHEME_KINDS = ("Ending", "Prefinal", "Particle", "Suffix", "Prefix")


def merge(analyses: DataFrame, by: tuple[str, ...] = ("word",)) -> DataFrame:
    """One row for each (lemmas, morphemes, unchanged, noun-forming 이): rules are a sorted set; a reading without a spelling demand absorbs those with one."""
    keyed = analyses.withColumn("noun_i", F.array_contains("rules", "suffix.nominal.i"))
    df = keyed.groupBy(*by, "lemmas", "morphemes", "unchanged", "noun_i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("rules"), F.min(F.size("spellings")).alias("__free"), F.array_sort(F.collect_set("spellings")).alias("__paths"))
    return df.withColumn("spelling_paths", F.when(F.col("__free") == 0, F.expr("cast(array() as array<array<string>>)")).otherwise(F.col("__paths"))).drop("__free", "__paths", "noun_i")


def lemma_strings(analyses: DataFrame, by: tuple[str, ...] = ("word",)) -> DataFrame:
    """The sorted distinct lemma texts of each word."""
    return analyses.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("lemmas", lambda x: x["text"]))))).alias("lemma_strings"))
