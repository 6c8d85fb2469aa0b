"""Vector codes: product quantisation in whole numbers, each nearest codebook entry found by VA-file filtering.

A component x becomes floor(1024 * x); a vector is cut into PARTS equal parts, and each part is coded by the nearest of
at most ENTRIES entries of its part's codebook. Codebooks start as the parts of the smallest vec_ids; each round assigns
every part and replaces each entry by the floored mean of its parts.

The search for the nearest entry is the VA-file's: the entries' coordinates are quantised to CELLS cells a dimension, with as many
entries in each. For a query, a table of each dimension and cell holds the least and the greatest squared distance to the cell; the sums
over the cells of an entry bound its distance from below and above. The greatest bound is taken of the entry with the least
lower bound, and only entries whose lower bound does not exceed it are compared by their integer distance: no other entry can be nearest or tied.

Each round is one narrow map over the vectors, which sends at most PARTS * ENTRIES sums a task, and one small aggregation.
Codebooks (PARTS * ENTRIES * length / PARTS numbers, whatever the input) are all that reaches the driver or is sent to tasks.

Defined cases: a vector that is null, or has a null or non-finite component, is dropped, as is one that cannot be cut like the others (of
other length than the kept vector of the smallest vec_id; all, if that length is no positive multiple of PARTS) or has a component of 16,384 or more
in size, whose distances 64 bits could not hold; a null vec_id sorts last; rows of equal vec_id sort by their vectors; equal rows are coded each; entries
of equal distance: the lower index; with fewer than ENTRIES vectors there are as many entries as vectors; null labels are one label; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, look_up

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELLS = 16
#: Components are below this in size once scaled.
LIMIT = 1 << 24
#: Query parts whose tables are in memory together.
CHUNK = 1024


def cells_of(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each entry in each dimension, and the least and greatest coordinate in each cell (dimension, cell).
    Cells hold about equally many entries; equal coordinates share one, so an empty cell may be left, which no entry uses."""
    k, width = entries.shape
    n = min(CELLS, k)
    cuts = np.sort(entries, axis=0)[np.arange(1, n) * k // n]
    cell = np.stack([np.searchsorted(cuts[:, d], entries[:, d], side="right") for d in range(width)], 1)
    low, high = np.zeros((width, n), np.int64), np.zeros((width, n), np.int64)
    for d in range(width):
        for c in np.unique(cell[:, d]):
            inside = entries[cell[:, d] == c, d]
            low[d, c], high[d, c] = inside.min(), inside.max()
    return cell, low, high


class VaFile:
    """The entries of one codebook behind their cells."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.cell, self.low, self.high = cells_of(entries)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower bounds (entry, query), the entry of the least lower bound of each query, and that entry's upper bound."""
        k, width = self.entries.shape
        lower, row = np.zeros((k, len(queries)), np.int64), np.empty((k, len(queries)), np.int64)
        tables = []
        for d in range(width):
            q = queries[:, d]
            below, above = self.low[d][:, None] - q, q - self.high[d][:, None]
            gap = np.maximum(np.maximum(below, above), 0)
            np.take(gap * gap, self.cell[:, d], axis=0, out=row, mode="clip")
            lower += row
            tables.append(np.maximum(np.abs(below), np.abs(above)) ** 2)
        best = lower.argmin(0)
        every, upper = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        for d, table in enumerate(tables):
            upper += table[self.cell[best, d], every]
        return lower, best, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query (the lowest of several) and its squared distance."""
        codes, found = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for at in range(0, len(queries), CHUNK):
            some = queries[at : at + CHUNK]
            lower, _, upper = self.bounds(some)
            who, entry = np.nonzero((lower <= upper).T)  # by query, then entry
            gap = some[who] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            start = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            least = np.minimum.reduceat(distance, start)
            first = np.flatnonzero(distance == np.repeat(least, np.diff(np.r_[start, len(who)])))
            first = first[np.r_[True, who[first][1:] != who[first][:-1]]]
            codes[at : at + CHUNK], found[at : at + CHUNK] = entry[first], least
        return codes, found


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Kept vectors as whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, width)


def kept_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """vec_id, v and label of the rows that are coded, and the length of their vectors (0: no row is coded)."""
    rows = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("v"), F.col(f"`{label}`").alias("label"))
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LIMIT // SCALE), F.lit(False)))
    rows = rows.where(F.col("v").isNotNull() & fits)
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").first()
    width = len(first.v) if first else 0
    width = width if width % parts == 0 else 0
    return rows.where(F.size("v") == width) if width else rows.where("false"), width


def _sums(books: list[np.ndarray], width: int):  # noqa: ANN202
    """Adds up, in each task, the vectors of each entry: (part, entry, count, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, step = [VaFile(b) for b in books], width // len(books)
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            v = _whole(batch.column("v"), width)
            for p, f in enumerate(files):
                mine = v[:, p * step : (p + 1) * step]
                codes, _ = f.nearest(mine)
                counts[p] += np.bincount(codes, minlength=len(books[p]))
                np.add.at(sums[p], codes, mine)
        for p, (n, s) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p)), pa.array(used), pa.array(n[used]), pa.array(s[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def train_codebooks(kept: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, from all kept vectors."""
    step = width // parts
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.floor(np.array([r.v for r in seeds], np.float64) * SCALE).astype(np.int64)
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds):
        sums = kept.select("v").mapInArrow(_sums(books, width), "part long, entry long, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(step)]).alias("sums"))
        for r in total.collect():  # at most parts * entries rows
            books[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
    return books


def _codes(books: list[np.ndarray], width: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, step = [VaFile(b) for b in books], width // len(books)
        for batch in batches:
            v = _whole(batch.column("v"), width)
            found = [f.nearest(v[:, p * step : (p + 1) * step]) for p, f in enumerate(files)]
            code = [bytes(c).hex() for c in np.stack([c for c, _ in found], 1).astype(np.uint8)]
            error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(code, pa.string()), pa.array(error, pa.int64()), batch.column("label")], names=["vec_id", "code", "error", "label"])

    return run


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """vec_id, code, error and label of kept vectors."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("vec_id", "v", "label").mapInArrow(_codes(books, width), f"vec_id {kinds['vec_id']}, code string, error long, label {kinds['label']}")


def compress_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector. entries: 256 at most, so that an index is two hexadecimal digits."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    kept, width = kept_vectors(rows, vec_id, vector, label, parts)
    books = train_codebooks(kept, width, parts=parts, entries=entries, rounds=rounds) if width else []
    coded = cut(encode_vectors(kept, books, width), "codes") if width else kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label")
    # Labels as text, with one for null, so that the table of their sums can be joined by plain equality.
    coded = coded.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = cut(coded.groupBy("name").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    joined = look_up(coded, totals.select("name", "label_error"), "name", hot_keys(totals, "name", "n", coded.count()))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
