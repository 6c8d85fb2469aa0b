"""WARC archives: deduplicating writer, and a parallel reader that verifies the chain of record boundaries.

Writer. A page becomes a response record, or a revisit record if another page with the same payload has a
smaller id. The records are rows of Spark's text sink with the record terminator as line separator, which makes exactly the
bytes of a WARC file and uses Spark's own commit protocol and file systems.

Reader. Files are split at every occurrence of the version line, whether it starts a record or is part of a
payload. Each task emits its candidates: offset, and the successor offset that the candidate's header claims. Within
a split, candidates are followed to the first offset beyond it; between splits, pointer jumping from each file's start,
with distances doubled each round, finds where the true chain enters each split; within the splits it is then
followed from there. Only candidates on the chain are records; the rest is payload and is put back into the
record around it. Whole records are digested where they are read; only payloads that hold a version line are moved.

Ids keep their type: they are written percent-encoded and read back as the type of the column. Heads and payloads
may have any length. Defined cases: a null payload is an empty one; of pages with equal payloads the smallest id is the response; a null id reads back as null, and is revisited only if no page
with the same payload has an id; rows with equal ids and payloads are all responses if theirs is the smallest
id; a record whose block has not its stated length, or whose payload not its stated SHA-1, is an error; line breaks in a URL are written as %0A and %0D; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_group, by_two_groups, cut, hot_keys, look_up

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_BYTES = 0
MAX_RECORDS = 20_000
#: Repeated payloads up to which their table is sent to every task.
BROADCAST_ROWS = 100_000
_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits, 5 at a time to 4 digits."""
    h = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(h, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]), *_BASE32)


def with_roles(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, and original: the page that this one revisits, else null."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    first = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = cut(first, "repeated")
    named = first.select("digest", "first")
    if first.count() <= BROADCAST_ROWS:  # about 100 bytes a row; beyond that the pages of all but hot digests are dealt by digest
        joined = rows.join(F.broadcast(named), "digest", "left")
    else:
        joined = look_up(rows, named, "digest", hot_keys(first, "digest", "n", rows.count()), "left")
    return joined.select("page_id", "url", "html", "digest", "size", F.when(F.coalesce(F.col("page_id") > F.col("first"), F.col("first").isNotNull()) & ((F.col("size") >= min_bytes)), F.col("first")).alias("original"))


def _record(date: str) -> Column:
    uri = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    body = F.when(F.col("original").isNull(), F.concat(http, F.col("html"))).otherwise(http)
    again = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.url_encode(F.col("original").cast("string")), F.lit(">\r\n"))
    return F.concat(
        F.lit(f"{VERSION}WARC-Type: "), F.when(F.col("original").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page"), F.coalesce(F.concat(F.lit(":"), F.url_encode(F.col("page_id").cast("string"))), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"), F.when(F.col("original").isNotNull(), again).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(body), F.lit(END), body,
    )


def write_warc(pages: DataFrame, path: str, *, date: str = "2000-01-01T00:00:00Z", max_records: int = MAX_RECORDS, **options) -> None:
    with_roles(pages, **options).select(_record(date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max_records).text(path)


def _field(header: str, name: str) -> Column:
    return F.nullif(F.regexp_extract(header, f"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(df: DataFrame) -> DataFrame:
    """Header fields of what follows a version line (value), without looking into the payload."""
    df = df.withColumn("header", F.substring_index("value", END, 1))
    df = df.withColumn("content", F.expr("try_cast(regexp_extract(header, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]{1,15})[ \\t]*(?:\\r\\n|$)', 1) as bigint)"))
    return df.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.octet_length("header").cast("long") + 4)


SAID = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stated_digest"]


def _contents(df: DataFrame, keep: list[str], kind: str) -> DataFrame:
    """keep, and what a whole record (value, header, content, head) says of its page, and in what it is not as its header says (fault)."""
    df = df.withColumns({
        "block": F.expr("substring(cast(value as binary), cast(head + 1 as int), cast(content as int))"),
        "http": F.expr("octet_length(substring_index(substring(value, char_length(header) + 5), '\\r\\n\\r\\n', 1)) + 4"),
        "digest": F.substring_index(_field("header", "WARC-Payload-Digest"), ":", -1),
        "type": _field("header", "WARC-Type"),
    })
    whole, payload, top = F.col("type") == "response", F.expr("substring(block, http + 1)"), F.expr("cast(substring(block, 1, http) as string)")
    found = F.when(whole, base32_sha1(payload)).otherwise(F.col("digest"))
    short = F.octet_length("block") != F.col("content")
    wrong = whole & (F.upper(F.substring_index(_field("header", "WARC-Payload-Digest"), ":", 1)) == "SHA1") & (found != F.upper("digest"))
    fault = F.when(short, "a record's block is not of its stated length: ").when(wrong, "a payload has not its stated digest: ")
    page = lambda name: F.try_url_decode(F.regexp_extract("header", f"(?i){name}:[ \\t]*<urn:page:([^>]*)>", 1)).try_cast(kind)
    page_of = lambda name: F.when(F.col("header").rlike(f"(?i){name}:[ \\t]*<urn:page:"), page(name))
    return df.select(
        *keep, page_of("WARC-Record-ID").alias("page_id"),
        F.when(whole, F.octet_length(payload)).otherwise(F.regexp_extract(top, "(?i)\r\nContent-Length:[ \t]*([0-9]+)", 1).try_cast("bigint")).cast("long").alias("payload_bytes"),
        found.alias("payload_digest"), F.concat(fault, F.col("header")).alias("fault"),
        F.col("type").alias("record_type"), page_of("WARC-Refers-To").alias("refers_to"), F.col("digest").alias("stated_digest"),
    )


def _exits(_: tuple, t: pa.Table) -> pa.Table:
    """For each candidate of a split, where its chain leaves the split: pointer jumping until nothing moves."""
    t = t.sort_by("off")
    off, nxt = t["off"].to_numpy(), t["nxt"].to_numpy()
    k = np.minimum(np.searchsorted(off, nxt), len(off) - 1)
    to = np.where(off[k] == nxt, k, -1)
    end = np.where(to < 0, np.arange(len(off)), to)
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    return pa.table({"file": t["file"], "off": t["off"], "leaves": pa.array(nxt[end])})


def _walk(_: tuple, entries: pa.Table, t: pa.Table) -> pa.Table:
    """The candidates of a split on the chain from where it enters."""
    t = t.sort_by("off")
    off, nxt = t["off"].to_numpy(), t["nxt"].to_numpy()
    on = np.isin(off, entries["off"].to_numpy())
    k = np.minimum(np.searchsorted(off, nxt), max(len(off) - 1, 0))
    to = np.where(off[k] == nxt, k, -1) if len(off) else k
    for i in range(len(off)):  # successors lie behind
        if on[i] and to[i] >= 0:
            on[to[i]] = True
    keep = pa.array(on)
    return t.select(["file", "split", "off", "nxt"]).filter(keep)


def boundary_chain(candidates: DataFrame) -> DataFrame:
    """The candidates (file, split, off, nxt) that the chain from offset 0 of their file reaches."""
    exits = cut(candidates.groupBy("file", "split").applyInArrow(by_group(_exits), "file string, off long, leaves long"), "exits")
    jump = exits.select("file", "off", F.col("leaves").alias("to"))
    reached = cut(exits.where("off = 0").select("file", "off"), "reached")
    n = reached.count()
    while True:
        more = cut(reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).union(reached).distinct(), "reached")
        m = more.count()
        if m == n:
            break
        n, reached = m, more
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.off")), "left")
        jump = cut(far.select("a.file", "a.off", F.coalesce("b.to", "a.to").alias("to")), "jumps")
    where = cut(candidates.select("file", "split", "off").join(reached, ["file", "off"]), "entries")
    return where.groupBy("file", "split").cogroup(candidates.groupBy("file", "split")).applyInArrow(by_two_groups(_walk), "file string, split long, off long, nxt long")


def read_warc(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """What the records say (SAID), with file and off, the offset of the record. kind: the type of page ids."""
    raw = spark.read.option("lineSep", VERSION).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))
    # Splits and their order hold for one scan only. Bytes that are read anew are found by what they are.
    sha = F.sha2(F.col("value").cast("binary"), 256)
    whole = F.coalesce(F.col("head") + F.col("content") + 4 == F.col("size"), F.lit(False))
    seg = _parsed(raw).withColumn("whole", whole).withColumn("raw", F.when(~F.col("whole"), F.col("value"))).withColumn("sha", F.when(F.col("whole"), sha))
    # One pass over the bytes keeps what a whole segment says, and the bytes of the others.
    segs = cut(_contents(seg, ["file", "split", "seq", "size", "head", "content", "whole", "raw", "sha"], kind), "segments")
    step = F.col("size") + len(VERSION)
    base = segs.groupBy("file", "split").agg(F.sum(step).alias("n"))
    base = base.select("file", "split", (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("base"))
    within = F.sum(step).over(Window.partitionBy("file", "split").orderBy("seq")) - step
    placed = segs.withColumn("within", within).join(base, ["file", "split"])
    placed = cut(placed.withColumn("off", F.col("base") + F.col("within") - len(VERSION)).where("off >= 0").drop("base", "within"), "placed")
    cand = placed.where("content is not null").select("file", "split", "off", (F.col("off") + len(VERSION) + F.col("head") + F.col("content") + 4).alias("nxt"))
    records = cut(boundary_chain(cand), "records").select("file", "off", "nxt")
    rows = cut(placed.join(records, ["file", "off"], "left"), "rows")
    easy = rows.where("whole and nxt is not null")
    # Records around version lines in their payloads are put together from their segments.
    rest = rows.where("not whole or nxt is null").select("file", "off", "nxt", "raw", "sha")
    owner = F.last(F.when(F.col("nxt").isNotNull(), F.struct("off", "nxt")), ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
    rest = cut(rest.withColumn("owner", owner).where("off < owner.nxt"), "nested")
    inner = rest.where("raw is null").select("sha").distinct()
    if not inner.isEmpty():  # complete records inside a payload
        again = raw.select("value").withColumn("sha", sha).join(inner, "sha", "left_semi").groupBy("sha").agg(F.any_value("value").alias("bytes"))
        rest = rest.join(again, "sha", "left").withColumn("raw", F.coalesce("raw", "bytes", F.raise_error(F.concat(F.lit("bytes of a record were not found again: "), F.col("file")))))
    parts = rest.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("off", "raw"))).alias("p"))
    joined = parts.select("file", F.col("owner.off").alias("off"), F.array_join(F.transform("p", lambda x: x["raw"]), VERSION).alias("value"))
    found = easy.select("file", "off", *SAID, "fault").unionByName(_contents(_parsed(joined), ["file", "off"], kind))
    told = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat("fault", F.lit(" at "), F.col("off").cast("string"), F.lit(" of "), "file"))).otherwise(F.col("payload_digest"))
    return found.withColumn("payload_digest", told).drop("fault")


def archive_pages(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes pages to WARC files under path and returns what their records say."""
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path, pages.schema[options.get("page_id", "page_id")].dataType.simpleString())
