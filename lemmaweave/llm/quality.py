"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every word and every pair of neighbouring words of a text falls into one of BUCKETS buckets of its order. The
raw-corpus multinomials count the buckets over all documents; the trusted-target multinomials over the trusted
ones, a deterministic sample of at most TRUSTED labelled rows. A document's score is the mean over its n-grams
of log(p_target / p_raw), in units of 1 / SCALE and rounded for each bucket, so
that sums are whole numbers and the verdict does not depend on their order. One is added to each raw count; the target
has PRIOR more n-grams that are dealt as the raw corpus is, so that a bucket that few trusted documents speak of is neutral, in a small
corpus as in a large one. A document is kept if it
passes the base rules, its score is at least THRESHOLD and it has fewer than TOXIC_WORDS distinct toxic words.

A mean over a whole text hides a few telling words: it keeps all of the labelled toxic documents of 50 words that are of quality 1. So the same ratio is also
taken of single hashed words, by documents, between the two parts of a deterministic sample of at most TRUSTED labelled rows: a word is toxic
if it is in TOXIC_DOCS toxic documents at least and its log ratio (others to toxic, one added to the others' count) is -log(TOXIC_RATIO) or less. The README
has figures of this and of the tail of the ratio to the raw corpus, which cannot tell toxic words from those of large groups of copies.

Only the bucket counts (2 * BUCKETS rows, whatever the input) and the toxic words of the bounded sample reach
the driver; texts are never shuffled.

Defined cases: null and wordless texts have no words and fail the base rules; a text of any length is judged whole; a score at the threshold is kept, and buckets have no order, so there are no ties; repeated rows are counted and
judged each; without trusted documents all scores are 0, and without toxic ones no word is toxic, so the base rules decide; an empty table gives no rows; other columns are
carried (keep_quality) or ignored (judge_quality), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positional

BUCKETS = 8192
TRUSTED = 20_000
SCALE = 10_000
#: N-grams of the raw corpus that the target has besides its own.
PRIOR = 50_000
THRESHOLD = -0.05
TOXIC_DOCS = 5
TOXIC_RATIO = 20
TOXIC_WORDS = 2
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """The runs of other than ASCII white space."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that the optimizer cannot copy into the expressions (and lambdas) that use them."""
    for name, c in columns.items():
        df = df.select("*", F.explode(F.array(c)).alias(name))
    return df


def _buckets(words: str) -> Column:
    """The bucket of each word, then of each pair."""
    return F.concat(
        F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")),
        F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: (F.pmod(F.xxhash64(w, F.get(F.col(words), i + 1)), F.lit(BUCKETS)) + BUCKETS).cast("int")),
    )


def bucket_ratios(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", trusted: int = TRUSTED) -> list[int]:
    """The rounded log ratio of each bucket: of words, then of pairs."""
    good = labels.where((F.col(quality) == 1) & (F.col(toxic) == 0)).select(F.col("doc_id").alias("__good")).distinct().orderBy(F.xxhash64("__good"), "__good").limit(trusted)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), words_of(F.col(f"`{text}`")).alias("__w")).join(F.broadcast(good), F.col("id") == F.col("__good"), "left")
    flat = once(rows.select(F.col("__good").isNotNull().cast("long").alias("good"), F.col("__w")), words=F.col("__w")).select("good", F.explode(_buckets("words")).alias("bucket"))
    raw, target = [0] * (2 * BUCKETS), [0] * (2 * BUCKETS)
    for b, n, g in flat.groupBy("bucket").agg(F.count(F.lit(1)), F.sum("good")).collect():
        raw[b], target[b] = n, g
    if not any(target):
        return [0] * (2 * BUCKETS)
    out = []
    for a in (0, BUCKETS):
        r, t = raw[a : a + BUCKETS], target[a : a + BUCKETS]
        n, m = sum(r) + BUCKETS, sum(t) + PRIOR
        for x, y in zip(r, t, strict=True):
            p = (x + 1) / n
            out.append(round(SCALE * (math.log((y + PRIOR * p) / m) - math.log(p))))
    return out


def toxic_words(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = TRUSTED) -> list[int]:
    """The hashes of the words that tell the toxic documents of the labelled sample from its others."""
    known = labels.where(F.col(toxic).isNotNull()).groupBy(F.col("doc_id").alias("__known")).agg(F.max((F.col(toxic) == 1).cast("long")).alias("bad")).orderBy(F.xxhash64("__known"), "__known").limit(sample)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(known), F.col("id") == F.col("__known"))
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    words = rows.select("bad", F.explode(F.array_distinct(words_of(F.col("t")))).alias("w")).groupBy(F.xxhash64("w").alias("h")).agg(F.sum("bad").alias("x"), F.count(F.lit(1)).alias("of"))
    telling = (F.col("x") >= TOXIC_DOCS) & (F.col("x") * (n - bad) >= TOXIC_RATIO * (F.col("of") - F.col("x") + 1) * bad)
    return sorted(r.h for r in words.where(telling).select("h").collect())


def _measured(docs: DataFrame, text: str, ratios: list[int], toxic: list[int], prefix: str) -> DataFrame:
    """docs with the base columns and the score, their names prefixed."""
    p, t = prefix, F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = once(docs, **{f"{p}w": words_of(F.col(f"`{text}`"))})
    w = F.col(f"{p}w")
    size = F.size(w)
    triples = F.transform(F.slice(w, 1, F.greatest(size - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    df = once(df, **{f"{p}h": triples})
    h = F.col(f"{p}h")
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    ordered = F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = once(df, **{f"{p}s": ordered})
    s = F.col(f"{p}s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twice = F.filter(s, lambda x, j: same(x, j + 1) | same(x, j - 1))
    df = once(df, **{f"{p}p": F.sort_array(F.transform(twice, lambda x: x["i"]))})
    at = F.col(f"{p}p")
    covered = F.aggregate(F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = once(df, **{f"{p}l": lines})
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    total = F.aggregate(F.transform(_buckets(f"{p}w"), lambda b: F.get(table, b)), F.lit(0).cast("long"), lambda a, x: a + x)
    symbols = sum((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    vile = F.size(F.array_distinct(F.filter(w, lambda x: F.xxhash64(x).isin(toxic)))) if toxic else F.lit(0)
    df = df.withColumns({
        f"{p}n_toxic": vile,
        f"{p}n_words": size.cast("long"),
        f"{p}word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        f"{p}n_symbols": symbols.cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        f"{p}n_repeat_words": covered.cast("long"),
        f"{p}llr": F.coalesce(total / F.nullif(F.greatest(2 * size - 1, F.lit(0)), F.lit(0)), F.lit(0.0)) / SCALE,
    })
    return df.drop(*[f"{p}{x}" for x in "whspl"])


def _verdict(p: str, threshold: float) -> tuple[Column, Column]:
    failed = (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))
    return failed, ~failed & (F.col(f"{p}llr") >= threshold) & (F.col(f"{p}n_toxic") < TOXIC_WORDS)


def judge_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and llr of each document."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    df = _measured(rows, "text", bucket_ratios(rows, labels), toxic_words(rows, labels), "")
    failed, kept = _verdict("", threshold)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "llr")


def keep_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that judge_quality keeps, with their own columns."""
    d = positional(docs)
    at_id, at_text = (f"c{docs.columns.index(c)}" for c in (doc_id, text))
    df = _measured(d, at_text, bucket_ratios(d, labels, doc_id=at_id, text=at_text), toxic_words(d, labels, doc_id=at_id, text=at_text), "q_")
    return df.where(_verdict("q_", threshold)[1]).select(*d.columns).toDF(*docs.columns)
