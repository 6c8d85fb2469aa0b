"""Length-delimited binary records of token ids, with an offset index.

A record is: the length of its data (unsigned 64-bit), the masked CRC-32C of those eight bytes, the data, the
masked CRC-32C of the data; all little-endian. The data are a document's ids, as 16-bit numbers if the
vocabulary allows, else 32-bit ones. Shards cover ascending ranges of document ids and are sorted within.
The index is a Parquet table beside them: for each record its shard, place in the shard, byte offset and size, and the ids before it in
the shard; any subset can be read in any order, each with one seek.

A task writes its shard under a name of its own and renames it at the end, so lost or repeated tasks leave
whole files only; the shard's number comes from the range partition, so a repeated task writes the same shard. Files go
through pyarrow's file systems, by the URI of the shared folder.

Defined cases: a null text is an empty one and gives the end id alone; a text of any length is one record; records of one id are ordered by their texts, and equal rows are equal records; null ids come first; rows that share an
id follow each other, by text; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_for, narrow
from .crc32c import crc32c, masked
from .tokenize import encoder, slices

SHARD_BYTES = 32 << 20
READ_BYTES = 8 << 20
_FRAME = 16  # bytes of a record besides its data


def _file_system(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def frames(parts: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in parts]
    a, b = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(parts)).astype("<u4")
    return [n + x.tobytes() + p + y.tobytes() for n, x, p, y in zip(lengths, a, parts, b, strict=True)]


def unframe(records: list[bytes]) -> list[bytes]:
    """The data of whole records, after their lengths and checksums are verified."""
    data = [r[12:-4] for r in records]
    heads = [r[:8] for r in records]
    if any(int.from_bytes(h, "little") != len(d) for h, d in zip(heads, data, strict=True)):
        raise ValueError("a record's length does not fit its place in the index")
    if records:
        a = np.frombuffer(b"".join(r[8:12] for r in records), "<u4")
        b = np.frombuffer(b"".join(r[-4:] for r in records), "<u4")
        if (a != masked(crc32c(heads))).any() or (b != masked(crc32c(data))).any():
            raise ValueError("a record's checksum does not fit its bytes")
    return data


INDEX = "doc_id {}, shard int, place long, byte_offset long, n_bytes long, width int, ids_before long"


def write_records(docs: DataFrame, tokenizer: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards and index under path and returns the index."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_rows = rows.repartitionByRange(groups_for(rows, "text", shard_bytes), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, at, place, before = encoder(tokenizer), None, 0, 0, 0
        wide = enc.lib.get_vocab_size() > 1 << 16
        shard = TaskContext.get().partitionId()
        fs, root = _file_system(path)
        own, name = f"{root}/.shard-{shard:06d}-{uuid.uuid4().hex}", f"{root}/shard-{shard:06d}.rec"
        for b in batches:
            first = 0
            for texts in slices(b.column(1)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own)
                ids, n = enc.arrays(texts, end_id)
                raw, ends = ids.astype("<u4" if wide else "<u2").tobytes(), (4 if wide else 2) * np.cumsum(n)
                made = frames([raw[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
                size = np.fromiter(map(len, made), np.int64, len(made))
                out.write(b"".join(made))
                k = len(made)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, k), pa.array(np.full(k, shard, np.int32)), pa.array(np.arange(place, place + k)), pa.array(at + np.cumsum(size) - size), pa.array(size), pa.array(np.full(k, 4 if wide else 2, np.int32)), pa.array(before + np.cumsum(n) - n)], names=["doc_id", "shard", "place", "byte_offset", "n_bytes", "width", "ids_before"])
                first, place, at, before = first + k, place + k, at + int(size.sum()), before + int(n.sum())
        if out is not None:
            out.close()
            fs.move(own, name)

    sorted_rows.mapInArrow(narrow(run), INDEX.format(kind)).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX.format(kind)).parquet(f"{path}/index")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """index with n_tokens and ids_crc32, from the records that it names; neighbouring records share a read."""
    kept = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(path)
        for b in batches:
            shard, at, size, width = (b.column(kept.index(c)).to_numpy() for c in ("shard", "byte_offset", "n_bytes", "width"))
            tokens, crc = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            k = 0
            while k < len(at):
                m = k + 1
                while m < len(at) and shard[m] == shard[k] and at[m] == at[m - 1] + size[m - 1] and at[m] + size[m] - at[k] <= READ_BYTES:
                    m += 1
                with fs.open_input_file(f"{root}/shard-{shard[k]:06d}.rec") as f:
                    f.seek(int(at[k]))
                    raw = f.read(int(at[m - 1] + size[m - 1] - at[k]))
                data = unframe([raw[a : a + n] for a, n in zip((at[k:m] - at[k]).tolist(), size[k:m].tolist(), strict=True)])
                for i, (d, w) in enumerate(zip(data, width[k:m].tolist(), strict=True), k):
                    tokens[i] = len(d) // w
                    crc[i] = zlib.crc32(d if w == 4 else np.frombuffer(d, "<u2").astype("<u4").tobytes())
                k = m
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens), pa.array(crc)], names=[*kept, "n_tokens", "ids_crc32"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in index.dtypes)
    return index.mapInArrow(narrow(run), f"{kinds}, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str, path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that it writes under path and reads back."""
    index = write_records(docs, tokenizer, path, **options)
    read = read_records(index, path)
    last = index.groupBy("shard").agg(F.max(F.struct("place", F.expr("ids_before + (n_bytes - 16) / width").cast("long").alias("n")))["n"].alias("n"))
    # One row a shard: a few for each GB.
    base = last.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return read.join(base, "shard").select("doc_id", (F.col("base") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32", "shard", "byte_offset")
