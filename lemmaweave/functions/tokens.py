"""Tokenizer: runs of white space, single marks, and words, with byte spans; and what words need before analysis."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

# Unicode White_Space; the categories P*, S*, Cc and Cf; and what is left, which is words.
SPACE = r"\t-\r\x{85}\p{Z}"
MARK = r"\p{P}\p{S}\p{Cc}\p{Cf}"
REST = r"\p{L}\p{N}\p{M}\p{Cn}\p{Co}\p{Cs}"
#: Words first: they are most, and the three classes have no character in common.
TOKEN = f"[{REST}]++|[{SPACE}]++|[{MARK}]"


def tokens_of(text: Column) -> Column:
    """The tokens of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def kind_of(surface: Column) -> Column:
    """The kind of a token, from its first character; ASCII and Hangul need no pattern."""
    c = F.ascii(surface)
    letter = c.between(97, 122) | c.between(65, 90) | c.between(48, 57) | c.between(0xAC00, 0xD7A3)
    return F.when(letter, "word").when((c == 32) | c.between(9, 13), "whitespace").when(c < 128, "punctuation").when(surface.rlike(f"^[{SPACE}]"), "whitespace").when(surface.rlike(f"^[{MARK}]"), "punctuation").otherwise("word")


def tokenize(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), spans: bool = True) -> DataFrame:
    """keys, ordinal, surface, start, end (half-open UTF-8 byte span; left out without spans) and kind: one row a token, no shuffle.

    Spans come from prefix sums of token lengths within the row. A null text has no tokens."""
    rows = df.select(*keys, tokens_of(F.col(text)).alias("__t"))
    if not spans:
        flat = rows.select(*keys, F.posexplode("__t").alias("ordinal", "surface"))
        return flat.select(*keys, "ordinal", "surface", kind_of(F.col("surface")).alias("kind"))
    rows = rows.select(*keys, "__t", starts_of(F.transform("__t", lambda x: F.octet_length(x))).alias("__b"))
    flat = rows.select(*keys, "__b", F.posexplode("__t").alias("ordinal", "surface"))
    start = F.get("__b", F.col("ordinal"))
    return flat.select(*keys, "ordinal", "surface", start.alias("start"), (start + F.octet_length("surface")).alias("end"), kind_of(F.col("surface")).alias("kind"))


@F.arrow_udf(ArrayType(LongType()))
def starts_of(sizes: pa.Array) -> pa.Array:
    """Exclusive prefix sums of each array. A fold in the JVM copies its result at each step, so this is by Arrow batch."""
    ends = np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    n = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    before = np.concatenate([np.zeros(1, np.int64), ends])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(before[:-1] - np.repeat(before[offsets[:-1]], n)))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt to all of them before work by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition, for which Spark has no function."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalized(df: DataFrame, text: str) -> DataFrame:
    """df with a text column in canonical composition. ASCII and composed Hangul are so already and stay in the JVM."""
    plain = F.coalesce(F.col(text).rlike(r"^[\x{0}-\x{7F}\x{AC00}-\x{D7A3}]*$"), F.lit(True))
    return df.where(plain).unionByName(df.where(~plain).withColumn(text, nfc(F.col(text))))


def word_errors(word: Column) -> Column:
    """Why a word cannot be analysed, else null."""
    return F.when(word.isNull() | (word == ""), "empty word").when(word.rlike(f"[{SPACE}]"), "white space in word")
