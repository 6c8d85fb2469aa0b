"""Best-fit packing of token sequences with certified bin counts.

Documents are tokenized in one narrow map that keeps lengths and checksums only. Pieces of the full length
are sequences by themselves. The other pieces are dealt to partitions of bounded size by their row number;
each partition packs them best-fit decreasing and computes a lower bound of its bin count from families of
dual feasible functions. A partition that meets its bound is certified and final. The others keep their full
bins, which waste nothing, and exchange the documents of their open bins: these are dealt anew,
so that each meets documents of others, and packed again, until all bounds are met or an exchange saves no bin.

Defined cases: a null text is an empty one and gives the end token alone; every row is a document of its own
even if rows repeat or share an id; of equal lengths the first row is packed first; a text of any length is cut into as many pieces as it needs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, narrow
from .tokenize import encoder, slices

CAPACITY = 1024
PART_ITEMS = 100_000
#: Stands for the level in the numbers of sequences that one piece fills.
FULL = 127


def cut_pieces(n_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece: all but a document's first have the full length."""
    pieces, first = -(-n_tokens // capacity), (n_tokens - 1) % capacity + 1
    doc = np.repeat(np.arange(len(n_tokens)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
    return doc, piece, start, np.where(piece > 0, capacity, first[doc])


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in slices(b.column(1)):
                ids, n = encoder(tokenizer).arrays(texts, end_id)
                doc, piece, start, length = cut_pieces(n, capacity)
                raw, first = ids.astype("<u4").tobytes(), 4 * ((np.cumsum(n) - n)[doc] + start)
                crc = [zlib.crc32(memoryview(raw)[x:y]) for x, y in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                ids = b.column(0).slice(at, len(texts)).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(texts)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(narrow(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the free room of each bin. A bit mask of the gaps in use finds the
    tightest bin that fits."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    bins, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    for i in order:
        n = size[i]
        fits = mask >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = stacks[gap].pop()
            if not stacks[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, len(room)
            room.append(capacity)
        bins[i], offset[i] = b, capacity - gap
        left = room[b] = gap - n
        if left:
            stacks[left].append(b)
            mask |= 1 << left
    return bins, offset, np.array(room, np.int64)


def bin_lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins from the volume and two families of dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]  # items of x or more
    volume = np.concatenate([[0], np.cumsum(count * x)])
    for t in range(1, capacity // 2 + 1):  # 1 above C-t, 0 below t, its share between
        big = int(above[capacity - t + 1]) if t > 0 else 0
        mid = int(volume[capacity - t + 1] - volume[t])
        best = max(best, big - (-mid // capacity))
    for k in range(1, 101):  # rounds (k+1)x/C down, unless it is whole
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        value = np.where(whole, k * x, capacity * (scaled // capacity))  # times k*C
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def _pack_group(capacity: int, level: int):  # noqa: ANN202
    names = ["row", "bucket", "bin", "offset", "final", "bins", "bound"]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["row"].to_numpy(), kind="stable")))
        length = t["length"].to_numpy()
        bins, offset, room = best_fit_decreasing(length, capacity)
        bound = bin_lower_bound(length, capacity)
        final = np.ones(len(room), bool) if len(room) <= bound else room == 0
        bucket = key[0].as_py()
        n = len(length)
        return pa.table([t["row"], pa.array(np.full(n, bucket, np.int64)), pa.array((np.int64(level) << 56) + (np.int64(bucket) << 30) + bins), pa.array(offset), pa.array(final[bins]), pa.array(np.full(n, len(room), np.int64)), pa.array(np.full(n, bound, np.int64))], names=names)

    return run


PACKED = "row long, bucket long, bin long, offset long, final boolean, bins long, bound long"


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> DataFrame:
    """pieces (with a column length) plus sequence_id and offset; certified is true where the partition met its bound."""
    cols = pieces.columns
    rows = cut(pieces.select("*", F.monotonically_increasing_id().alias("row")), "pieces")
    open_ = rows.where(F.col("length") < capacity).select("row", "length")
    n, bins, level, done = open_.count(), None, 0, []
    while n:
        parts = -(-n // part_items)
        dealt = open_.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts)))
        packed = cut(dealt.groupBy("bucket").applyInArrow(by_group(_pack_group(capacity, level)), PACKED), "packed")
        made = packed.groupBy("bucket").agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        rest = packed.where("not final")
        again = rest.select("bin").distinct().count()
        # An exchange that saves no sequence ends the search; so does a single partition, which has no one to exchange with.
        last = not again or parts == 1 or (bins is not None and made >= bins)
        final = packed if last else packed.where("final")
        done.append(final.select("row", F.col("bin").alias("sequence_id"), "offset", (F.col("bins") <= F.col("bound")).alias("certified")))
        if last:
            break
        open_ = cut(rest.select("row").join(rows.select("row", "length"), "row"), "open")
        n, bins, level = open_.count(), again, level + 1
    full = rows.where(F.col("length") >= capacity).select("row", (F.lit(FULL << 56) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    placed = reduce(DataFrame.unionByName, done, full)
    return rows.join(placed, "row").select(*cols, "sequence_id", "offset", "certified")


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Tokenizes, cuts and packs docs."""
    own = {k: options.pop(k) for k in ("doc_id", "text", "end_id") if k in options}
    return pack_pieces(tokenized_pieces(docs, tokenizer, capacity=options.get("capacity", CAPACITY), **own), **options)
