"""Helpers that the corpus operators share: shared storage, lineage cuts, words and packed keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, drop_cut, fresh_path, shared_dir

__all__ = ["cut", "drop_cut", "fresh_path", "shared_dir"]

#: Text that one group of documents holds when documents are dealt to groups by hash.
GROUP_BYTES = 12 << 20


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs: it waits for the driver's garbage collection."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that are run inside have at most so many rows an Arrow batch; the session's setting is put back after them."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


#: Rows of an Arrow batch, unless the session says otherwise: a batch of whole documents is some MB on both sides.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are bounded, if they are at Spark's default."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "10000":
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


# ---- worker memory -----------------------------------------------------------------------------

#: What workers hold beyond a task: each is called with the stage that begins, and gives back what is of others.
_HOLDERS: list[Callable[[int], None]] = []


def at_stage(give_back: Callable[[int], None]) -> None:
    _HOLDERS.append(give_back)


def _tidy() -> None:
    """Gives free memory back to the system, as idle workers stay beside the executor and other workers."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _begin() -> None:
    if (task := TaskContext.get()) is not None:
        for give_back in _HOLDERS:
            give_back(task.stageId())


def narrow(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; the worker is tidied at the end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        try:
            yield from run(batches)
        finally:
            _tidy()

    return tidied


def by_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """run for applyInArrow; the worker is tidied after large groups."""

    def tidied(key: tuple, t: pa.Table) -> pa.Table:
        _begin()
        large = t.nbytes > 1 << 20
        out = run(key, t)
        if large:
            del t
            _tidy()
        return out

    return tidied


def by_two_groups(run: Callable[[tuple, pa.Table, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """run for applyInArrow of cogroups; the worker is tidied after large groups."""

    def tidied(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        _begin()
        large = left.nbytes + right.nbytes > 1 << 20
        out = run(key, left, right)
        if large:
            del left, right
            _tidy()
        return out

    return tidied


def free_name(taken: Iterable[str], stem: str) -> str:
    """stem, or stem with a number, whichever no column of taken has in any case."""
    have, k = {c.lower() for c in taken}, 0
    while (name := f"{stem}{k or ''}").lower() in have:
        k += 1
    return name


def positional(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 and so on, so that no column of a caller meets one of an operator."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def without_rows(docs: DataFrame, doc_id: str, text: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that found names. found gets doc_id, text and digest (of the text), and returns doc_id and digest:
    a row is told by both, as rows may share an id."""
    d = positional(docs)
    at_id, at_text = (f"c{docs.columns.index(x)}" for x in (doc_id, text))
    digest = F.xxhash64(F.coalesce(F.col(at_text), F.lit("")), F.length(at_text))
    gone = found(d.select(F.col(at_id).alias("doc_id"), F.col(at_text).alias("text"), digest.alias("digest"))).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    return d.withColumn("digest", digest).join(gone, (F.col(at_id) == F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti").drop("digest").toDF(*docs.columns)


#: A key is hot from one in so many rows on; so there are no more hot keys than this.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys that hold a thousandth of the total or more, at most a thousand, from their counts."""
    return [r[0] for r in counts.where(F.col(n) >= max(2, -(-total // HOT_SHARE))).select(key).collect()]


def look_up(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row a key: those of hot keys by broadcast of at most HOT_SHARE rows, so that they
    stay where they are; the others by a shuffle."""
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(~is_hot).join(table, key, how).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how))


def groups_for(docs: DataFrame, text: str = "text", per_group: int = GROUP_BYTES) -> int:
    """The number of hash groups for the documents, from their measured bytes."""
    n = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    return max(8, -(-((n[0] or 0) + 64 * n[1]) // per_group))


def int_partitions(docs: DataFrame, at_least: int = 1) -> int:
    return max(at_least, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """A-Z only, unlike lower()."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- word hashes -------------------------------------------------------------------------------

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64 over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order; both are mixed, so no sum or power of one makes up for the other."""
    return mix(mix(a ^ _M1) + b)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values, from those of runs of 1, 2, 4 and so on."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, h, 1
    while True:
        if n & size:
            out = run[:m] if out is None else joined(out, run[done : done + m])
            done += size
        if done == n:
            return mix(out) if n == 1 else out
        run, size = joined(run[:-size], run[size:]), 2 * size


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes of text hashed at once, but for a longer word.
CHUNK_BYTES = 8 << 20


_KEY = 0x5851F42D4C957F2D


def _hash_words(data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes and the starts of the words of bytes that end in a separator."""
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    packed = data[word]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[packed] if lower else packed)])
    coded = words.dictionary_encode()  # equal words by their bytes; each is hashed once
    _, edges, body = coded.dictionary.buffers()
    own, body = np.frombuffer(edges, np.int64)[: len(coded.dictionary) + 1].tolist(), body.to_pybytes() if body else b""
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[a:b], _KEY) for a, b in zip(own[:-1], own[1:], strict=True)]), "<u8").reshape(-1, 2)
    at = coded.indices.to_numpy()
    return digests[at, 0], digests[at, 1], start


def word_keys(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes (the halves of a keyed XXH3) of the words (runs of other than ASCII white space) of all texts in turn,
    and each text's number of words. Works through the bytes in chunks that end between words, so memory does not follow the length of a text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # a separator after each text
    first, second, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        stop = at + CHUNK_BYTES
        while stop < len(data) and not (gap := np.flatnonzero(_SPACE[data[stop : stop + CHUNK_BYTES]])[:1]).size:
            stop += CHUNK_BYTES
        stop = min(stop + int(gap[0]) + 1, len(data)) if stop < len(data) else len(data)
        h, g, s = _hash_words(data[at:stop], lower)
        first.append(h)
        second.append(g)
        starts.append(s + at)
        at = stop
    start = np.concatenate(starts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return np.concatenate(first), np.concatenate(second), np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The first hashes of word_keys, and each text's number of words."""
    h, _, n = word_keys(texts, lower)
    return h, n


def take(g: np.ndarray | None, at: np.ndarray) -> np.ndarray | None:
    return None if g is None else g[at]


def order_of(h: np.ndarray, g: np.ndarray | None) -> np.ndarray:
    """A stable order by h, then g, if any: a second sort is needed only where two keys share their first half."""
    order = np.argsort(h, kind="stable")
    if g is not None:
        hs, gs = h[order], g[order]
        if ((hs[1:] == hs[:-1]) & (gs[1:] != gs[:-1])).any():
            order = np.lexsort((g, h))
    return order


def leads(h: np.ndarray, g: np.ndarray | None) -> np.ndarray:
    """Where a new key begins in ordered keys."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if g is not None:
        new[1:] |= g[1:] != g[:-1]
    return new


def find(th: np.ndarray, tg: np.ndarray | None, h: np.ndarray, g: np.ndarray | None) -> np.ndarray:
    """The place of each key (h, g) in the ordered distinct keys (th, tg), or -1."""
    out = np.full(len(h), -1)
    if not len(th):
        return out
    at = np.searchsorted(th, h)
    live = np.arange(len(h))
    while live.size:
        live = live[at[live] < len(th)]
        live = live[th[at[live]] == h[live]]
        if tg is None:
            out[live] = at[live]
            break
        hit = tg[at[live]] == g[live]
        out[live[hit]] = at[live[hit]]
        live = live[~hit]
        at[live] += 1
    return out


def byte_slices(texts: list[str | None], limit: int) -> list[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) in runs of about limit bytes, null as empty."""
    out, run, size, first = [], [], 0, 0
    for k, t in enumerate(texts):
        b = (t or "").encode()
        if run and size + len(b) > limit:
            out.append((first, run))
            run, size, first = [], 0, k
        run.append(b)
        size += len(b)
    if run:
        out.append((first, run))
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket in the order of the hashes."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


# ---- packed arrays -----------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def _unplanes(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as byte planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64)


def pack_checks(g: np.ndarray, size: int = 4) -> bytes:
    """Values of size bytes as they are: hashes hold nothing to compress."""
    return np.ascontiguousarray(g.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size]).tobytes()


def unpack_checks(b: bytes, size: int = 4) -> np.ndarray:
    out = np.zeros((len(b) // size, 4), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.view("<u4").reshape(-1).astype(np.uint64)


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as byte planes of what they exceed their minimum by."""
    v = values.astype(np.int64, copy=False)
    low = v.min() if len(v) else np.int64(0)
    return int(low).to_bytes(8, "little", signed=True) + _planes((v - low).view(np.uint64))


def unpack(b: bytes) -> np.ndarray:
    return (_unplanes(b[8:], np.uint64).view(np.int64)) + np.int64(int.from_bytes(b[:8], "little", signed=True))
