"""Import of a dictionary in LMF JSON: singletons or arrays at each level, as VARIANT paths and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The entities that the export escapes once.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}
ENTRY_URL = "https://krdict.korean.go.kr/kor/dicSearch/SearchView?ParaWordNo="


def decode_entities(c: Column) -> Column:
    """The listed entities and numeric ones, once: each match is looked up, so a decoded & never starts another."""
    parts = F.regexp_extract_all(c, F.lit(r"&(?:amp|lt|gt|quot|apos|nbsp|#[0-9]{1,8}|#x[0-9A-Fa-f]{1,8});|[^&]+|&"), F.lit(0))
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def number(x: Column) -> Column:
        code = F.when(x.startswith("&#x"), F.conv(F.regexp_extract(x, "&#x([0-9A-Fa-f]+);", 1), 16, 10)).otherwise(F.regexp_extract(x, "&#([0-9]+);", 1)).cast("bigint")
        return F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(x)

    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^&#x?[0-9A-Fa-f]+;$"), number(x)).otherwise(F.coalesce(F.try_element_at(named, x), x))), "")


def many(v: Column, path: str) -> Column:
    """A level of the export as an array of VARIANT, whether it is an array, one object or absent."""
    level = F.try_variant_get(v, path, "variant")
    as_array = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(as_array, F.when(level.isNotNull(), F.array(level)), F.expr("cast(array() as array<variant>)"))


def features(v: Column, name: str) -> Column:
    """The values of the features of one name."""
    hits = F.filter(many(v, "$.feat"), lambda f: F.try_variant_get(f, "$.att", "string") == name)
    return F.transform(F.filter(hits, lambda f: F.try_variant_get(f, "$.val", "string").isNotNull()), lambda f: decode_entities(F.try_variant_get(f, "$.val", "string")))


def feature(v: Column, name: str) -> Column:
    return F.coalesce(F.get(features(v, name), F.lit(0)), F.lit(""))


def _sense(s: Column) -> Column:
    return F.struct(
        F.try_variant_get(s, "$.val", "string").alias("id"), feature(s, "definition").alias("definition"),
        F.transform(many(s, "$.Equivalent"), lambda t: F.struct(feature(t, "language").alias("language"), feature(t, "lemma").alias("lemma"), feature(t, "definition").alias("definition"))).alias("translations"),
        F.transform(many(s, "$.SenseExample"), lambda e: features(e, "example")).alias("examples"),
        F.concat(features(s, "annotation"), features(s, "syntacticAnnotation")).alias("notes"), features(s, "syntacticPattern").alias("patterns"),
    )


def parse_entries(raw: DataFrame, entry: str = "entry") -> DataFrame:
    """Dictionary rows of LMF entries (VARIANT), with an error for entries that break the format."""
    e = F.col(entry)
    heads = F.flatten(F.transform(many(e, "$.Lemma"), lambda x: features(x, "writtenForm")))
    unit = feature(e, "lexicalUnit")
    source = F.when(F.try_variant_get(e, "$.att", "string") == "id", F.try_variant_get(e, "$.val", "string"))
    df = raw.select(source.alias("source_id"), heads.alias("heads"), unit.alias("lexical_unit"), feature(e, "homonym_number").alias("homonym"), feature(e, "partOfSpeech").alias("pos"), feature(e, "vocabularyLevel").alias("level"), features(e, "origin").alias("origins"), features(e, "annotation").alias("notes"), F.transform(many(e, "$.WordForm"), lambda f: F.struct(feature(f, "type").alias("kind"), feature(f, "writtenForm").alias("written"), features(f, "pronunciation").alias("pronunciations"))).alias("forms"), F.transform(many(e, "$.Sense"), _sense).alias("senses"))
    head, ids = F.get("heads", F.lit(0)), F.transform("senses", lambda s: s["id"])
    error = (
        F.when(F.col("source_id").isNull() | ~F.col("source_id").rlike("^[0-9]+$"), "invalid identifier").when((F.size("heads") != 1) | (F.trim(head) == ""), "expected one headword")
        .when(F.size("senses") == 0, "missing senses").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate sense").when(F.exists("senses", lambda s: s["definition"] == ""), "missing definition")
    )
    derived = F.concat(F.lit(":"), F.sha2(F.concat("lexical_unit", F.lit("\u0000"), head), 256))
    id_ = F.concat(F.lit("krdict:"), "source_id", F.when(F.col("lexical_unit").isin("관용구", "속담"), derived).otherwise(""))
    return df.select(id_.alias("id"), head.alias("headword"), "homonym", "pos", F.concat(F.lit(ENTRY_URL), "source_id").alias("url"), "level", "lexical_unit", "origins", "notes", "forms", "senses", error.alias("error"))


def read_lmf(spark: SparkSession, path: str) -> DataFrame:
    """All entries of LMF JSON files, one row an entry."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    return parse_entries(doc.select(F.explode(many(F.col("doc"), "$.LexicalResource.Lexicon.LexicalEntry")).alias("entry")))


def import_lmf(spark: SparkSession, path: str, to: str) -> DataFrame:
    """Writes the dictionary table, whole or not at all and never over another (see storage.publish); a faulty entry stops it."""
    from ..functions.tokens import nfc
    from ..storage import publish

    df = read_lmf(spark, path)
    checked = df.withColumn("id", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "id", "error"))).otherwise(F.col("id"))).drop("error")
    publish(checked.withColumn("lookup", nfc(F.col("headword"))), to)
    return spark.read.parquet(to)
