"""Structured Streaming over texts."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tokens import tokenize
from ..plans.analyze import analyze_words


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of the lines that arrive in a folder."""
    return spark.readStream.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def token_stream(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens of a stream: stateless, so any output mode and any restart are safe."""
    return tokenize(docs, text, keys)


def analyze_stream(docs: DataFrame, sink, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)):  # noqa: ANN001, ANN201
    """A writer that analyses the distinct words of each micro-batch and hands (tokens, analyses, batch id) to sink."""

    def each(batch: DataFrame, number: int) -> None:
        tokens = tokenize(batch, text, keys).persist()
        try:
            sink(tokens, analyze_words(tokens.where("kind = 'word'").select(F.col("surface").alias("text"))), number)
        finally:
            tokens.unpersist()

    return docs.writeStream.foreachBatch(each)


_HELD = "pending binary, base long, next long, done boolean, seqs array<long>, blocks array<binary>, lasts array<boolean>"


def _boundary(text: str) -> int:
    """The last place where a token certainly ends: before white space of ASCII that follows something else."""
    for k in range(len(text) - 1, 0, -1):
        if text[k] in " \t\n\v\f\r" and not text[k - 1].isspace():
            return k
    return 0


def _joined():  # noqa: ANN202
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, base, at, done, seqs, blocks, lasts = state.get if state.exists else (b"", 0, 0, False, [], [], [])
        held = dict(zip(seqs, zip(blocks, lasts, strict=True), strict=True))
        for part in parts:
            for seq, block, last in zip(part["seq"], part["block"], part["last"], strict=True):
                held.setdefault(int(seq), (bytes(block), bool(last)))
        out: list[tuple[int, str, str | None]] = []
        while not done and at in held:
            block, done = held.pop(at)
            at, pending = at + 1, bytes(pending) + block
            error = None
            try:
                text, used = codecs.utf_8_decode(pending, "strict", done)
                end = len(text) if done else _boundary(text)
            except UnicodeDecodeError as e:
                text, used, done = pending[: e.start].decode(), e.start, True
                end, error = len(text), f"invalid UTF-8 at byte {base + e.start}"
            whole = text[:end]
            size = len(whole.encode())
            if whole or error:
                out.append((base, whole, error))
            pending, base = pending[size:], base + size
        late = sorted((k, *v) for k, v in held.items() if k >= at and not done)  # what came twice, or after the end, is dropped
        state.update((bytes(b"" if done else pending), base, at, done, [k for k, _, _ in late], [b for _, b, _ in late], [x for _, _, x in late]))
        rows = pd.DataFrame(out, columns=["base", "text", "error"])
        rows.insert(0, "doc_id", [key[0]] * len(out))
        yield rows

    return run


def join_blocks(blocks: DataFrame) -> DataFrame:
    """doc_id, base (byte offset), text and error of texts that arrive as a stream of byte blocks: doc_id, seq (from 0), block and last.

    Blocks may cut characters and tokens anywhere, come in any order and come twice. What is carried from batch to batch is the end of a text that
    may still go on (one token, and a cut character) and the blocks that wait for an earlier one. Pieces end between tokens, so that token_stream(keys=("doc_id", "base"))
    gives the tokens of the whole text, with spans from base on. At a fault, or where the last block ends within a character, the text before it is
    given out with the error, and the rest of that text is left out. A null last is false."""
    kind = blocks.schema["doc_id"].dataType.simpleString()
    rows = blocks.select("doc_id", F.col("seq").cast("long").alias("seq"), F.coalesce("block", F.lit(b"")).alias("block"), F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("doc_id").applyInPandasWithState(_joined(), f"doc_id {kind}, base long, text string, error string", _HELD, "append", GroupStateTimeout.NoTimeout)
