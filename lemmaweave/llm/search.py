"""Ranked lexical search over document shards.

Index. A narrow map gathers about SHARD_BYTES of text a shard. A shard is one row: its documents in the order of their ids, its
terms, and for each term its postings in compressed sparse rows: the places of the documents that hold it, and for each an
integer impact, which needs nothing but the document and two numbers of the whole corpus (counted in a pass before). The
index holds every term of every document and is a table like any other, so that it can be kept and searched again.

Search. Queries are dealt to blocks by the bytes of their texts; for each block one pass over the terms sums the document frequencies of
its terms, and one pass over the shards scores them, a term at a time: the impacts of the term, times its weight, are added to a dense array
of the shard's documents. The best of a shard are cut out by argpartition, where all above the last place are taken and
of those that tie with it the smallest ids. Shards' bests are merged by rank.

Weights are floor(1000 ln((2N + 2) / (2 df + 1))), impacts (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, all else whole numbers of 64 bits.

Defined cases: a null, empty or termless text is no document and a query without results; a text of any length is one document; equal
scores go by ascending doc_id (null last), rows that share an id and a score in any order, each with a rank of its own; rows that share an item_id
are queries of their own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, fresh_path, pack, unpack

TOP = 10
SHARD_BYTES = 16 << 20
#: Query texts that are with the driver, and sent to the tasks, at once.
BLOCK_BYTES = 4 << 20
_TERM = bytes.maketrans(bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() else 32 for c in range(128)))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all that is not ASCII; only A-Z in lower case."""
    return text.encode().translate(_TERM).split() if text else []  # what is no term is a space by now


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = words = 0
    for b in batches:
        for text in b.column("text").to_pylist():
            n = len(terms_of(text))
            documents, words = documents + (n > 0), words + n
    yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([words])], names=["documents", "words"])


class _Shard:
    """Documents on their way to a row of the index."""

    def __init__(self, documents: int, words: int) -> None:
        self.documents, self.words, self.bytes = documents, words, 0
        self.ids: list = []
        self.norms: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []

    def add(self, doc_id: object, text: str, terms: list[bytes]) -> None:
        found, of = Counter(terms), self.numbers
        self.ids.append(doc_id)
        self.norms.append(10 + 90 * len(terms) * self.documents // self.words)
        self.codes.append(np.fromiter((of.setdefault(t, len(of)) for t in found), np.int32, len(found)))
        self.tf.append(np.fromiter(found.values(), np.int64, len(found)))
        self.bytes += len(text)

    def row(self, shard: int, kind: pa.DataType) -> pa.RecordBatch:
        ids = pa.array(self.ids, kind)
        order = pc.sort_indices(ids).to_numpy()  # nulls are last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        held = np.array([len(c) for c in self.codes])
        doc, code, tf = np.repeat(place, held), np.concatenate(self.codes), np.concatenate(self.tf)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(np.array(self.norms, np.int64), held))
        run = np.lexsort((doc, code))
        starts = np.cumsum(np.bincount(code, minlength=len(self.numbers)))
        columns = [pa.array([shard]), pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in (b" ".join(self.numbers), pack(starts), pack(doc[run]), pack(impact[run])))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "terms", "ends", "places", "impacts"])


def _index(documents: int, words: int, shard_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard(documents, words)
        kind = None
        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if terms := terms_of(text.as_py()):
                    shard.add(doc_id, text.as_py(), terms)
                    if shard.bytes >= shard_bytes:
                        yield shard.row(number, kind)
                        number, shard = number + 1, _Shard(documents, words)
        if shard.ids:
            yield shard.row(number, kind)

    return run


def build_index(docs: DataFrame, path: str | None = None, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs, written to path (or a fresh place in the shared folder) and read again. Every row also carries the two numbers of the corpus."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    path = path or fresh_path(spark, "search-index")
    with arrow_rows(spark, 500):
        total = rows.select("text").mapInArrow(_sizes, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
        documents, words = total[0] or 0, total[1] or 0
        kind = rows.schema["doc_id"].dataType.simpleString()
        shards = rows.mapInArrow(_index(documents, words, shard_bytes), f"shard long, ids array<{kind}>, terms binary, ends binary, places binary, impacts binary")
        # Row groups of a few shards, so that no reader holds many of them at once.
        shards.withColumns({"documents": F.lit(documents).cast("long"), "words": F.lit(words).cast("long")}).write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.parquet(path)


def _frequencies(wanted):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = pa.array(wanted.value[0], pa.binary())
        total = np.zeros(len(want), np.int64)
        for b in batches:
            for terms, ends in zip(b.column("terms").to_pylist(), b.column("ends").to_pylist(), strict=True):
                at = pc.index_in(want, value_set=pa.array(terms.split(b" "), pa.binary())).fill_null(-1).to_numpy()
                has = np.flatnonzero(at >= 0)
                total[has] += np.diff(unpack(ends), prepend=0)[at[has]]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["term", "df"])

    return run


def best(scores: np.ndarray, top: int) -> np.ndarray:
    """The places of the top greatest scores above 0, and of equal scores the first ones."""
    if len(scores) > top:
        last = scores[np.argpartition(scores, len(scores) - top)[len(scores) - top]]
        if last > 0:
            above = np.flatnonzero(scores > last)
            return np.concatenate([above, np.flatnonzero(scores == last)[: top - len(above)]])
    return np.flatnonzero(scores > 0)


def _score(sent, top: int, kind: pa.DataType):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, queries = sent.value
        want = pa.array(terms, pa.binary())
        for b in batches:
            for ids, held, ends, places, impacts in zip(*[b.column(c) for c in ("ids", "terms", "ends", "places", "impacts")], strict=True):
                at = pc.index_in(want, value_set=pa.array(held.as_py().split(b" "), pa.binary())).fill_null(-1).to_numpy()
                ends, places, impacts = (unpack(x.as_py()) for x in (ends, places, impacts))
                starts = np.r_[0, ends[:-1]]
                scores, who, where, what = np.zeros(len(ids), np.int64), [], [], []
                for number, query in enumerate(queries):
                    scores[:] = 0
                    for t in query:
                        if (k := at[t]) >= 0:
                            scores[places[starts[k] : ends[k]]] += weights[t] * impacts[starts[k] : ends[k]]
                    found = best(scores, top)
                    who.append(np.full(len(found), number))
                    where.append(found)
                    what.append(scores[found])
                found = ids.values.take(pa.array(np.concatenate(where)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), found.cast(kind), pa.array(np.concatenate(what))], names=["query", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries as (item_id, terms), in blocks of about limit bytes of text."""
    block, size = [], 0
    for name, text in items.toLocalIterator():
        if block and size + len(text or "") > limit:
            yield block
            block, size = [], 0
        block.append((name, list(dict.fromkeys(terms_of(text)))))
        size += len(text or "")
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, *, item_id: str = "item_id", text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of each item."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = index.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))
    item_kind, doc_kind = asked.schema["item_id"].dataType, index.schema["ids"].dataType.elementType
    documents = (index.select("documents").first() or [0])[0]
    out = spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    for block in _blocks(asked, block_bytes):
        terms = sorted({t for _, query in block for t in query})
        number = {t: k for k, t in enumerate(terms)}
        with arrow_rows(spark, 1):
            sent = spark.sparkContext.broadcast((terms,))
            found = index.select("terms", "ends").mapInArrow(_frequencies(sent), "term long, df long").groupBy("term").agg(F.sum("df")).collect()
            sent.destroy()
            df = dict(map(tuple, found))
            weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))]
            sent = spark.sparkContext.broadcast((terms, weights, [[number[t] for t in query] for _, query in block]))
            scored = index.drop("documents", "words").mapInArrow(_score(sent, top, to_arrow_type(doc_kind)), f"query long, doc_id {doc_kind.simpleString()}, score long")
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "ranked")
            sent.destroy()
        names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(block)], f"query long, item_id {item_kind.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def search_documents(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """search over a fresh index of docs."""
    return search(build_index(docs, doc_id=doc_id, text=text, shard_bytes=shard_bytes), items, **options)
