"""Substring deduplication by relative Lempel-Ziv parsing against reference blocks.

Every document of the corpus belongs to one reference block (by the hash of its id and text). What a block offers as
references are its word windows of the least factor length, each with the document and the word where it first stands: a
shorter factor is never a duplicate span, so the parse writes it as literals. The index of all blocks is dealt by phrase hash:

1. index: a narrow map packs, for each block, its distinct phrases with their first places, as sorted hashes in byte
   planes, dealt to buckets by hash;
2. look-up: each bucket sorts the phrases of every block together and tells each block which of its phrases
   start in an earlier document of another block, and where;
3. parse: with that and its own index, a block factors its documents greedily from left to right. A factor is a
   reference (document, word) and a length: it runs on while the reference does, so it is a verbatim copy of that
   stretch. Where the reference ends, the phrases across the factor boundary are looked up like any other, and the
   first that is found opens the next factor, which may overlap the last by up to the least length less one word.

The words that a factor covers are duplicates; nothing else decides. Of all places of a phrase only the first is
kept as a reference (the least document, then the least word), so a phrase that many documents share is
one entry for each block and slice, and goes to one bucket with millions of others; texts move once, by block.

Phrases are told apart by 88 bits, made of both halves of a keyed XXH3 of each word by mixing: of 10^13 distinct phrases (100 TB), two share
them with a probability of about 0.15, of 10^11 (1 TB) with 2e-5. Defined cases: null and wordless texts lose nothing; a row with
a null id neither loses words nor causes a removal; rows that share an id are the same document to the order, so they
do not shorten one another; ids are whole numbers (a column of another type is refused); a text of any length is hashed by the
megabyte; an empty table gives no rows; other columns are carried (dedup_texts) or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, by_group, by_two_groups, byte_slices, cut, find, groups_for, leads, narrow, order_of, pack, pack_checks, pack_sorted, positional, release, rolling, small_batches, unpack, unpack_checks, unpack_sorted, word_keys

MIN_FACTOR = 13
#: Bytes of a phrase's hash beyond 64 bits; a fourth would take the index beyond its disk budget.
CHECK_BYTES = 3
#: Text that is indexed at once: a batch, unless it holds very long documents. More and smaller slices take more disk.
SLICE_BYTES = 12 << 20
#: Text of a block; its parse takes about 30 times as much memory.
BLOCK_BYTES = 6 << 20
_NONE = np.iinfo(np.int64).max


def phrases(texts: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes (64 bits, and 24 more), the word each starts at, the index of its text, and the words of each text. Texts with id _NONE have none."""
    h, g, n = word_keys(texts)
    stop = np.cumsum(n)
    count = np.where(ids == _NONE, 0, np.maximum(n - least + 1, 0))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + (stop - n)[doc]
    return rolling(h, least)[at], (rolling(g, least) >> np.uint64(64 - 8 * CHECK_BYTES))[at], at, doc, n


def _index(least: int, buckets: int):  # noqa: ANN202
    names = ["bucket", "hashes", "checks", "blocks", "firsts", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("block", "ascending"), ("id", "ascending")])
            ids, block = t["id"].fill_null(_NONE).to_numpy(), t["block"].to_numpy()
            for first, texts in byte_slices(t["text"].to_pylist(), SLICE_BYTES):
                h, g, at, doc, n = phrases(texts, ids[first : first + len(texts)], least)
                at -= (np.cumsum(n) - n)[doc]
                order = order_of(h, g)  # by phrase, block, id and word
                h, g, at, doc = h[order], g[order], at[order], doc[order] + first
                own = block[doc]
                lead = leads(h, g)
                lead[1:] |= own[1:] != own[:-1]
                h, g, own, at, who = h[lead], g[lead], own[lead], at[lead], ids[doc[lead]]
                edges = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
                rows = [(k, pack_sorted(h[x:y]), pack_checks(g[x:y], CHECK_BYTES), pack(own[x:y]), pack(who[x:y]), pack(at[x:y])) for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if y > x]
                for k in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 64], strict=True)], names=names)

    return run


def _look_up(_: tuple, t: pa.Table) -> pa.Table:
    h = np.concatenate([unpack_sorted(x) for x in t["hashes"].to_pylist()])
    g = np.concatenate([unpack_checks(x, CHECK_BYTES) for x in t["checks"].to_pylist()])
    block, who, at = (np.concatenate([unpack(x) for x in t[c].to_pylist()]) for c in ("blocks", "firsts", "places"))
    order = np.lexsort((at, who, g, h))
    h, g, block, who, at = h[order], g[order], block[order], who[order], at[order]
    start = np.flatnonzero(leads(h, g))
    n = np.diff(np.r_[start, len(h)])
    first, place = np.repeat(who[start], n), np.repeat(at[start], n)
    late = who > first
    h, g, block, first, place = h[late], g[late], block[late], first[late], place[late]
    order = np.argsort(block, kind="stable")
    h, g, block, first, place = h[order], g[order], block[order], first[order], place[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(h) else np.empty(0, np.int64)
    ends = [*edges[1:].tolist(), len(h)]
    pairs = list(zip(edges.tolist(), ends, strict=True)) if len(edges) else []
    packed = {"hashes": (pack_sorted, h), "checks": (partial(pack_checks, size=CHECK_BYTES), g), "firsts": (pack, first), "places": (pack, place)}
    return pa.table({"block": pa.array([int(block[a]) for a, _ in pairs], pa.int64())} | {c: pa.array([f(x[a:b]) for a, b in pairs], pa.binary()) for c, (f, x) in packed.items()})


def factors(at: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of the phrases that have a reference (the word each starts at, and the reference's document and
    word): the first phrase of each factor, its words, and where its reference ends to run on."""
    if not len(at):
        return at, at, at
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(ref_doc) != 0) | (np.diff(ref_at) != 1)]
    first, last = np.flatnonzero(new), np.flatnonzero(np.r_[new[1:], True])
    return first, at[last] - at[first] + least, last


def parse_block(texts: list[bytes], ids: np.ndarray, told: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Words of each text, which of all words a factor covers, and the factors: text, start, length, reference's id and word.
    told: phrases with an earlier document in other blocks (ascending), that document and the word there."""
    h, g, at, doc, n = phrases(texts, ids, least)
    base = np.cumsum(n) - n
    own = at - base[doc]
    order = np.lexsort((own, ids[doc], g, h))
    hs, gs = h[order], g[order]
    first, place = np.full(len(h), _NONE), np.zeros(len(h), np.int64)
    if len(hs):
        start = np.flatnonzero(leads(hs, gs))
        who, where = ids[doc[order]][start], own[order][start]
        if len(told[0]):
            k = find(told[0], told[1], hs[start], gs[start])
            better = (k >= 0) & (told[2][k] < who)
            who, where = np.where(better, told[2][k], who), np.where(better, told[3][k], where)
        size = np.diff(np.r_[start, len(hs)])
        first[order], place[order] = np.repeat(who, size), np.repeat(where, size)
    k = np.flatnonzero(first < ids[doc])
    lead, length, _ = factors(at[k], first[k], place[k], least)
    lead = k[lead]
    covered = np.zeros(int(n.sum()) + 1, np.int64)
    np.add.at(covered, at[lead], 1)
    np.add.at(covered, at[lead] + length, -1)
    return n, np.cumsum(covered[:-1]) > 0, (doc[lead], own[lead], length, first[lead], place[lead])


def _parsed(base: DataFrame, at_id: int, at_text: int, least: int, fields: list[T.StructField], make) -> DataFrame:  # noqa: ANN001
    """base (with columns c0, c1 and so on) with the fields that make(words, keep, factors) gives for each document."""
    if not isinstance(base.schema[at_id].dataType, T.IntegralType):
        raise TypeError("ids are whole numbers")
    doc_id, text = F.col(f"c{at_id}"), F.col(f"c{at_text}")
    blocks = groups_for(base, f"c{at_text}", BLOCK_BYTES)
    spark = base.sparkSession
    # A row without an id takes no part, so it may be dealt anywhere, each time anew.
    dealt = base.withColumn("block", F.when(doc_id.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(blocks))).otherwise(F.pmod(F.xxhash64(doc_id, text), F.lit(blocks))).cast("long"))
    keyed = dealt.select(doc_id.cast("long").alias("id"), text.alias("text"), "block").where("id is not null")
    index = small_batches(keyed).mapInArrow(narrow(_index(least, blocks)), "bucket long, hashes binary, checks binary, blocks binary, firsts binary, places binary")
    known = cut(index.groupBy("bucket").applyInArrow(by_group(_look_up), "block long, hashes binary, checks binary, firsts binary, places binary"), "phrases")
    release(spark)
    out = T.StructType([*base.schema.fields, *fields])
    width = len(base.columns)

    def parse(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema.empty_table()
        h = np.concatenate([unpack_sorted(x) for x in right.column(1).to_pylist()] or [np.empty(0, np.uint64)])
        g = np.concatenate([unpack_checks(x, CHECK_BYTES) for x in right.column(2).to_pylist()] or [np.empty(0, np.uint64)])
        first, place = (np.concatenate([unpack(x) for x in right.column(k).to_pylist()] or [np.empty(0, np.int64)]) for k in (3, 4))
        order = order_of(h, g)
        texts = [(t or "").encode() for t in left.column(at_text).to_pylist()]
        ids = left.column(at_id).cast(pa.int64()).fill_null(_NONE).to_numpy()
        n, covered, (doc, *found) = parse_block(texts, ids, (h[order], g[order], first[order], place[order]), least)
        end, edges = np.cumsum(n), np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
        rows = []
        for k, (t, a, b) in enumerate(zip(texts, (end - n).tolist(), end.tolist(), strict=True)):
            words, some = t.split(), slice(edges[k], edges[k + 1])
            cut_ = some.stop > some.start
            rows.append(make(words, list(compress(words, ~covered[a:b])) if cut_ else words, [x[some] for x in found] if cut_ else None))
        new = [pa.array(c, type=k.type) for c, k in zip(zip(*rows, strict=True), list(out_schema)[width:], strict=True)]
        return pa.Table.from_arrays([*[left.column(i) for i in range(width)], *new], schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(out)
    right = known.select("block", "hashes", "checks", "firsts", "places")
    return dealt.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(by_two_groups(parse), out)


_FACTOR = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "ref_doc", "ref_start")]))


def duplicate_factors(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = MIN_FACTOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and factors (start, length, ref_doc, ref_start) of each document."""
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("factors", _FACTOR)]
    names = _FACTOR.elementType.names

    def make(words: list[bytes], kept: list[bytes], found: list[np.ndarray] | None) -> tuple:
        spans = [dict(zip(names, x, strict=True)) for x in zip(*[c.tolist() for c in found], strict=True)] if found else []
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans

    base = docs.select(F.col(f"`{doc_id}`").alias("c0"), F.col(f"`{text}`").alias("c1"))
    return _parsed(base, 0, 1, least, fields, make).drop("c1").withColumnRenamed("c0", "doc_id")


def dedup_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = MIN_FACTOR, n_chars: str | None = None) -> DataFrame:
    """docs with duplicate spans cut out of their texts: the kept words, joined by one space. A text that
    loses nothing is unchanged. n_chars: a column that follows the length of the text."""
    fields = [T.StructField("kept", T.StringType())]

    def make(words: list[bytes], kept: list[bytes], found: list[np.ndarray] | None) -> tuple:
        return (b" ".join(kept).decode() if found else None,)

    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    out = _parsed(positional(docs), docs.columns.index(doc_id), docs.columns.index(text), least, fields, make)
    new = {text: F.coalesce("kept", at[text])}
    if n_chars:
        new[n_chars] = F.when(F.col("kept").isNull(), F.col(at[n_chars])).otherwise(F.char_length("kept")).cast(docs.schema[n_chars].dataType)
    return out.select(*[new.get(c, F.col(at[c])).alias(c) for c in docs.columns])
