"""Language-model scores from a weighted backoff automaton.

The model has a state for the empty context and one for each word as a context. An arc of the empty context
carries the unigram probability of its word; an arc of a word's state carries the smoothed bigram
probability (c(h, w) + K p(w)) / (c(h) + K); a state without an arc for the next word follows its failure
arc, of weight K / (c(h) + K), to the empty context. These sum to one over the seen words and one class for
all unseen words, which has the mass of the words seen once (n1 / (N + n1)). A document is read once from left to right:
the state is carried along and log probabilities are added up.

The counts cover all training documents. They never meet in one place: documents belong to hash blocks; a
narrow map packs the distinct n-grams of each block with their training counts, dealt to buckets by hash; each bucket adds
them up and tells each block the counts of those of its n-grams that also occur in other blocks (the others'
counts it knows). So each block builds the part of the automaton that its documents can reach.

Words are told apart by 96 bits of a keyed XXH3 (of 10^10 distinct words two share them with a probability of 6e-10), so the counts of words are
exact; pairs by 64 bits mixed from two words: a pair that shares them with another has the sum of their counts.

Defined cases: a null or wordless text is the end token alone; a null id reads as an empty string when
documents are dealt to training; repeated rows are documents of their own (blocks follow id and text, so that only
rows equal in both meet for certain); equal counts need no order; a text of any length is hashed by the megabyte; without training documents every
word is unseen and all scores are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, by_group, by_two_groups, byte_slices, cut, find, groups_for, leads, narrow, order_of, pack, pack_checks, pack_sorted, release, rolling, small_batches, take, unpack, unpack_checks, unpack_sorted, word_keys

#: Text that is counted at once: a batch, unless it holds very long documents.
SLICE_BYTES = 12 << 20
#: Text of a block; its automaton takes about 60 times as much memory.
BLOCK_BYTES = 6 << 20
PRIOR = 2000.0
END = np.uint64(0x5851F42D4C957F2D)
_UPPER = np.uint64(32)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (64 bits, and 32 more) of the tokens of all texts, each with its end token, and the tokens of each text."""
    h, g, n = word_keys(texts, lower=True)
    at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out, checks = np.full(len(h) + len(n), END, np.uint64), np.full(len(h) + len(n), END >> _UPPER, np.uint64)
    out[at], checks[at] = h, g >> _UPPER
    return out, checks, n + 1


def bigrams(tokens: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it; a text starts after an end token."""
    return rolling(np.concatenate([[END], tokens]), 2)


def _count(buckets: int):  # noqa: ANN202
    names = ["kind", "bucket", "hashes", "checks", "blocks", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by("block")
            block, train = t["block"].to_numpy(), t["train"].to_numpy(zero_copy_only=False)
            for first, texts in byte_slices(t["text"].to_pylist(), SLICE_BYTES):
                tokens, checks, n = token_hashes(texts)
                own = np.repeat(block[first : first + len(texts)], n)
                weight = np.repeat(train[first : first + len(texts)], n).astype(np.int64)
                pairs = bigrams(tokens)
                for kind, (h, g) in enumerate(((tokens, checks), (pairs, None))):
                    order = order_of(h, g)
                    hs, gs, os = h[order], take(g, order), own[order]
                    new = leads(hs, gs)
                    new[1:] |= os[1:] != os[:-1]
                    start = np.flatnonzero(new)
                    c = np.add.reduceat(weight[order], start)
                    hs, gs, os = hs[start], take(gs, start), os[start]
                    edges = np.searchsorted(bucket_of(hs, buckets), np.arange(buckets + 1)).tolist()
                    rows = [(kind, k, pack_sorted(hs[x:y]), b"" if gs is None else pack_checks(gs[x:y]), pack(os[x:y]), pack(c[x:y])) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
                    for at in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(zip(*rows[at : at + 64], strict=True))], names=names)

    return run


def _merge(key: tuple, t: pa.Table) -> pa.Table:
    """For each block, the total counts of its n-grams that differ from its own; the statistics in a row of block -1."""
    kind = key[0].as_py()
    h = np.concatenate([unpack_sorted(x) for x in t["hashes"].to_pylist()])
    g = None if kind else np.concatenate([unpack_checks(x) for x in t["checks"].to_pylist()])
    block = np.concatenate([unpack(x) for x in t["blocks"].to_pylist()])
    c = np.concatenate([unpack(x) for x in t["counts"].to_pylist()])
    order = np.lexsort((block, h) if kind else (block, g, h))
    h, g, block, c = h[order], take(g, order), block[order], c[order]
    new = leads(h, g)
    new[1:] |= block[1:] != block[:-1]
    start = np.flatnonzero(new)
    own, h, g, block = np.add.reduceat(c, start), h[start], take(g, start), block[start]
    start = np.flatnonzero(leads(h, g))
    totals = np.add.reduceat(own, start)
    total = np.repeat(totals, np.diff(np.r_[start, len(h)]))
    tell = total != own
    tell = np.flatnonzero(tell)
    h, g, block, total = h[tell], take(g, tell), block[tell], total[tell]
    order = np.argsort(block, kind="stable")
    h, g, block, total = h[order], take(g, order), block[order], total[order]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist() if len(h) else []
    pairs = list(zip(edges, [*edges[1:], len(h)], strict=True)) if edges else []
    rows = [(int(block[a]), kind, pack_sorted(h[a:b]), b"" if kind else pack_checks(g[a:b]), pack(total[a:b]), 0, 0, 0) for a, b in pairs]
    rows.append((-1, kind, b"", b"", b"", int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum())))
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(col, k) for col, k in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "kind", "hashes", "checks", "counts", "n", "v", "n1"])


class BackoffAutomaton:
    """States are the empty context and word contexts by number; arcs of word contexts by state << 32 | word."""

    def __init__(self, root: list[float], failure: list[float], arcs: dict[int, float]) -> None:
        self.root, self.failure, self.arcs = root, failure, arcs

    def score(self, words: list[int], start: int) -> float:
        """The log probability of the words from the context start, in one traversal."""
        arcs, root, failure, state, total = self.arcs.get, self.root, self.failure, start, 0.0
        for w in words:
            p = arcs(state << 32 | w)
            total += failure[state] + root[w] if p is None else p
            state = w
        return total


Told = list[tuple[bytes, bytes, bytes]]


def _totals(h: np.ndarray, g: np.ndarray | None, local: np.ndarray, told: Told) -> np.ndarray:
    """Total counts of the distinct hashes (h, g): those told, else the local ones."""
    if not told:
        return local
    th = np.concatenate([unpack_sorted(a) for a, _, _ in told])
    tg = None if g is None else np.concatenate([unpack_checks(b) for _, b, _ in told])
    tc = np.concatenate([unpack(c) for _, _, c in told])
    order = order_of(th, tg)
    k = find(th[order], take(tg, order), h, g)
    return np.where(k >= 0, tc[order][k], local) if len(tc) else local


def score_block(texts: list[bytes], train: np.ndarray, told: tuple[Told, Told], n_all: int, v_all: int, n1: int, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n_tokens, n_known, base score and score of each text."""
    tokens, checks, n = token_hashes(texts)
    weight = np.repeat(train, n).astype(np.int64)
    end = np.cumsum(n)
    order = order_of(tokens, checks)
    new = leads(tokens[order], checks[order])
    word = np.empty(len(tokens), np.int64)
    word[order] = np.cumsum(new) - 1
    words, marks = tokens[order][new], checks[order][new]
    start = int(word[end[0] - 1])  # every text closes with the end token
    c1 = _totals(words, marks, np.bincount(word, weight, len(words)).astype(np.int64), told[0])
    pairs, at, pair = np.unique(bigrams(tokens), return_index=True, return_inverse=True)
    c2 = _totals(pairs, None, np.bincount(pair, weight, len(pairs)).astype(np.int64), told[1])
    unseen = max(n1, 1)
    p = np.where(c1 > 0, c1, unseen) / (n_all + unseen)
    before = np.concatenate([[start], word[:-1]])
    seen = np.flatnonzero(c2 > 0)
    hs, ws = before[at[seen]].astype(np.int64), word[at[seen]].astype(np.int64)
    arcs = np.log10((c2[seen] + prior * p[ws]) / (c1[hs] + prior))
    automaton = BackoffAutomaton(np.log10(p).tolist(), np.log10(prior / (c1 + prior)).tolist(), dict(zip((hs << 32 | ws).tolist(), arcs.tolist(), strict=True)))
    known = np.add.reduceat((c1[word] > 0).astype(np.int64), end - n)
    base = np.add.reduceat(np.log10((c1 + 1) / (n_all + v_all + 1))[word], end - n)
    flat = word.tolist()
    score = [automaton.score(flat[b - k : b], start) for b, k in zip(end.tolist(), n.tolist(), strict=True)]
    return n, known, base, np.array(score)


OUT = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out_of: int = 7, held_out: int = 2, prior: float = PRIOR) -> DataFrame:
    """Counts and log10 probabilities of each document; training leaves out crc32(id as text) mod held_out_of = held_out."""
    spark, blocks = docs.sparkSession, groups_for(docs, text, BLOCK_BYTES)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = keyed.withColumn("train", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_out_of != held_out)
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    counted = small_batches(keyed.select("text", "train", "block")).mapInArrow(narrow(_count(blocks)), "kind long, bucket long, hashes binary, checks binary, blocks binary, counts binary")
    told = cut(counted.groupBy("kind", "bucket").applyInArrow(by_group(_merge), "block long, kind long, hashes binary, checks binary, counts binary, n long, v long, n1 long"), "ngrams")
    release(spark)
    n_all, v_all, n1 = (x or 0 for x in told.where("block = -1 and kind = 0").agg(F.sum("n"), F.sum("v"), F.sum("n1")).first())

    def score(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(zip(right["kind"].to_pylist(), right["hashes"].to_pylist(), right["checks"].to_pylist(), right["counts"].to_pylist(), strict=True))
        told_of = tuple([tuple(r) for k, *r in rows if k == kind] for kind in (0, 1))
        train = left["train"].to_numpy().astype(bool)
        if not len(train):
            n = known = np.empty(0, np.int64)
            base = score = np.empty(0)
        else:
            n, known, base, score = score_block([(t or "").encode() for t in left["text"].to_pylist()], train, told_of, n_all, v_all, n1, prior)
        return pa.Table.from_arrays([left["doc_id"], pa.array(~train), pa.array(n), pa.array(known), pa.array(np.full(len(train), n_all, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    slices = told.where("block >= 0").select("block", "kind", "hashes", "checks", "counts")
    return keyed.groupBy("block").cogroup(slices.groupBy("block")).applyInArrow(by_two_groups(score), OUT.format(docs.schema[doc_id].dataType.simpleString()))
