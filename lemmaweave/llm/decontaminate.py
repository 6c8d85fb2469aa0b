"""Benchmark decontamination with word suffix arrays over the training text.

Each task indexes its documents in shards of at most SHARD_WORDS words. A shard's suffix array holds every
suffix that starts with a word of the benchmark (no other suffix can match one of its suffixes) in
lexicographic order; a word that the benchmark lacks ends a suffix, as nothing can match across it. Every
benchmark suffix is binary-searched in the array, word by word, which gives all places of its window; from there its
longest verbatim match at each place follows. A document whose text holds a window of an item is contaminated.

The benchmark travels to the tasks in blocks of at most BLOCK_BYTES (a single longer item is a block). One narrow map goes
through all blocks in turn for each batch of rows and holds one block at a time, so neither the size of the
benchmark nor that of the corpus is limited by a task's memory.

Defined cases: null or wordless text has no words and is clean; an item without words matches nothing;
an item with a null id is matched but cannot be listed, so it counts in n_hit alone; repeated item ids count
once; repeated rows are each judged, whatever their ids; of equally long matches the first in the text counts, then
the least item; a text of any length is judged whole; an empty table gives no rows; other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import narrow, positional

WINDOW = 10
SHARD_WORDS = 3 << 20
BLOCK_BYTES = 16 << 20
_MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())]))
#: matches: each longest verbatim match that holds a window, with its place in the text and in the item, in words.
OUT = (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType()), ("longest_match", T.LongType()), ("matches", _MATCHES))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Tests:
    """A block of benchmark items: word ids, suffixes and windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        self.vocab: dict[bytes, int] = {}
        flat, starts, widths, owners = [], [], [], []
        self.names = [name for name, _ in items]
        for owner, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text)]
            width = min(window, len(w))
            for i in range(len(w)):
                starts.append(len(flat) + i)
                widths.append(width if i + width <= len(w) else 0)
                owners.append(owner)
            flat += [*w, 0]
        self.flat = np.array(flat or [0], np.int64)
        self.starts, self.widths, self.owners = (np.array(x, np.int64) for x in (starts, widths, owners))
        self.first = {}
        for k, owner in enumerate(owners):
            self.first.setdefault(owner, starts[k])
        self.first = np.array([self.first.get(k, 0) for k in range(len(items))], np.int64)
        self.depth = max((len(words_of(t)) for _, t in items), default=0)


def suffix_array(ids: np.ndarray, depth: int, n_vocab: int) -> np.ndarray:
    """Starts of all suffixes with a known first word, ordered by their known words, up to depth words.
    ids ends with at least depth zeros."""
    bits = max(1, int(n_vocab).bit_length())
    m = 63 // bits

    def key(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for j in range(m):
            w = ids[np.minimum(at + j, len(ids) - 1)]
            alive &= w > 0
            out = (out << bits) | np.where(alive, w, 0)
        return out, alive

    pos = np.flatnonzero(ids > 0)
    k, alive = key(pos)
    order = np.argsort(k, kind="stable")
    pos, k, alive = pos[order], k[order], alive[order]
    group = np.cumsum(np.diff(k, prepend=k[:1]) != 0)
    here, done = np.arange(len(pos)), m
    while done < depth and len(here):
        g = group[here]
        tied = np.zeros(len(here), bool)
        same = g[1:] == g[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        here = here[tied & alive[here]]
        if not len(here):
            break
        at = pos[here]
        k, ok = key(at + done)
        order = np.lexsort((k, group[here]))
        pos[here], k, alive[here] = at[order], k[order], ok[order]
        g = group[here]
        group[here] = np.cumsum((np.diff(k, prepend=k[:1]) != 0) | (np.diff(g, prepend=g[:1]) != 0))
        done += m
    return pos


def search(ids: np.ndarray, sa: np.ndarray, t: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix: the range of the array that holds its window, and its longest match in the shard."""

    def bound(lo: np.ndarray, hi: np.ndarray, want: np.ndarray, d: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            v = ids[sa[mid] + d]
            less = v <= want[open_] if after else v < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    n = len(t.starts)
    lo, hi, best = np.zeros(n, np.int64), np.full(n, len(sa), np.int64), np.zeros(n, np.int64)
    wlo, whi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    for d in range(t.depth):
        want = t.flat[t.starts[live] + d]
        live, want = live[want > 0], want[want > 0]
        if not live.size:
            break
        a = bound(lo[live], hi[live], want, d, False)
        b = bound(a, hi[live], want, d, True)
        lo[live], hi[live] = a, b
        live = live[b > a]
        best[live] = d + 1
        full = live[t.widths[live] == d + 1]
        wlo[full], whi[full] = lo[full], hi[full]
    return wlo, whi, best


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indexes of the ranges, and which range each is of."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def judge(texts: list[str | None], t: Tests) -> list[tuple[int, bytes, list[str], list[tuple[int, int, str | None, int]]]]:
    """n_words, packed hits, listed items and matches (start, length, item, start in the item) of each text."""
    out: list[tuple[int, bytes, list[str], list[tuple[int, int, str | None, int]]]] = []
    shard: list[list[int]] = []
    get = t.vocab.get

    def flush() -> None:
        if not shard:
            return
        n = np.array([len(x) for x in shard], np.int64)
        first = np.cumsum(n + 1) - (n + 1)
        ids = np.zeros(int((n + 1).sum()) + t.depth + 64, np.int64)
        for at, x in zip(first, shard, strict=True):
            ids[at : at + len(x)] = x
        sa = suffix_array(ids, t.depth, len(t.vocab))
        wlo, whi, _ = search(ids, sa, t)
        delta = np.zeros(len(ids) + 1, np.int64)
        pairs = np.empty((0, 2), np.int64)
        matches: list[list[tuple[int, int, str | None, int]]] = [[] for _ in shard]
        if (hits := np.flatnonzero(whi > wlo)).size:
            at, which = _spread(wlo[hits], whi[hits])
            at, q = sa[at], hits[which]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + t.widths[q], -1)
            doc = np.searchsorted(first, at, side="right") - 1
            pairs = np.unique(np.stack([doc, t.owners[q]], 1), axis=0)
            # A match is longest if the place and the suffix before it do not match as well.
            key = at * len(t.flat) + t.starts[q]
            there = np.sort(key)
            before = key - len(t.flat) - 1
            k = np.minimum(np.searchsorted(there, before), len(there) - 1)
            alone = there[k] != before
            at, q, doc = at[alone], q[alone], doc[alone]
            n_same = t.widths[q].copy()
            live = np.arange(len(q))
            while live.size:  # each place's own match goes on beyond the window
                want = t.flat[t.starts[q[live]] + n_same[live]]
                live = live[(want > 0) & (ids[at[live] + n_same[live]] == want)]
                n_same[live] += 1
            owner = t.owners[q]
            for d, x, n_, o, y in zip(doc.tolist(), (at - first[doc]).tolist(), n_same.tolist(), owner.tolist(), (t.starts[q] - t.first[owner]).tolist(), strict=True):
                matches[d].append((x, n_, t.names[o], y))
        hit = np.cumsum(delta[:-1]) > 0
        items: list[list[str]] = [[] for _ in shard]
        for d, o in pairs.tolist():
            if t.names[o] is not None:
                items[d].append(t.names[o])
        for d, (at, k) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
            h = hit[at : at + k]
            out.append((k, np.packbits(h).tobytes() if h.any() else b"", items[d], matches[d]))
        shard.clear()

    size = 0
    for text in texts:
        ids = [get(w, 0) for w in words_of(text)]
        if size + len(ids) > SHARD_WORDS:
            flush()
            size = 0
        shard.append(ids)
        size += len(ids) + 1
    flush()
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    block, size = [], 0
    for name, body in benchmark.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        n = len((body or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((name, body))
        size += n
    if block:
        yield block


def find_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns of OUT instead of any of the same names. No shuffle: one narrow map."""
    spark = docs.sparkSession
    if text in dict(OUT):
        raise ValueError(f"the text column may not be named {text}")
    kept = [c for c in docs.columns if c not in dict(OUT)]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    found = _found(positional(base), kept.index(text), [spark.sparkContext.broadcast(Tests(block, window)) for block in _blocks(benchmark, item_id, item_text, block_bytes)])
    return found.toDF(*kept, *dict(OUT))


def _found(base: DataFrame, at_text: int, sent: list) -> DataFrame:  # noqa: ANN001
    """base (with columns c0, c1 and so on) with the columns of OUT after them."""
    outs = T.StructType([*base.schema.fields, *[T.StructField(n, k) for n, k in OUT]])
    types = [to_arrow_type(k) for _, k in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at_text).to_pylist()
            words, hits = [len(words_of(x)) for x in texts] if not sent else [], [b""] * len(texts)
            items: list[set[str]] = [set() for _ in texts]
            matches: list[list] = [[] for _ in texts]
            for block in sent:
                words = []
                for k, (n, hit, names, more) in enumerate(judge(texts, block.value)):
                    words.append(n)
                    if hit:
                        hits[k] = (np.frombuffer(hit, np.uint8) | np.frombuffer(hits[k], np.uint8)).tobytes() if hits[k] else hit
                        items[k].update(names)
                        matches[k] += more
                if len(sent) > 1:  # one block at a time
                    block.__dict__.pop("_value", None)
            n_hit = [sum(map(int.bit_count, x)) for x in hits]
            listed = [",".join(sorted(x)) for x in items]
            sorted_ = [sorted(x, key=lambda m: (m[0], m[2] is None, m[2] or "", m[3])) for x in matches]
            new = [
                words, n_hit, [len(x) for x in items], [hashlib.sha256(x.encode()).hexdigest() for x in listed], [x > 0 for x in n_hit],
                [max((m[1] for m in x), default=0) for x in matches], [[dict(zip(("start", "length", "item_id", "item_start"), m, strict=True)) for m in x] for x in sorted_],
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, k) for x, k in zip(new, types, strict=True)]], names=outs.names)

    return base.mapInArrow(narrow(run), outs)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    d = positional(docs)
    found = find_contaminated(d, benchmark, text=f"c{docs.columns.index(text)}", **options).where(~F.col("contaminated"))
    return found.select(*d.columns).toDF(*docs.columns)
