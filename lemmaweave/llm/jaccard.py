"""Near-duplicates by the Jaccard similarity of their sets of word shingles.

Candidates: op3's method (simhash.py), SimHash fingerprints linked through a forest of trees, over the sets of shingles and with as many bits as the similarity asks for.
Two sets of similarity 0.8 meet in no leaf with a probability of 5e-8, and 0.8 is the least that counts. Sets that are linked are joined to clusters, so that each
candidate's text is sent once, however many trees link it.

Verification: within a cluster, two sets are linked if their exact similarity is at least NEAR, a fraction in whole
numbers. A walk asks, for each set that it reaches, only those that it has not reached, so a large group of near
copies is not compared pair by pair. Equal sets are one node from the start. A cluster of at most BLOCK sets is compared in one task,
which reads its clusters one after another. In a larger one every set is first compared with a representative where it is; only what is not near it is
searched against the others, by pairs of blocks.

Words are as in op3: runs of other than ASCII white space, A-Z in lower case. Shingles are compared by 64-bit
hashes. Defined cases: a text of any length is one set, made by slices; of equal ids the first row stands for a set; a text of fewer words than a shingle is one shingle; wordless and null texts are equal to each
other; rows with a null id stay and link nothing; rows that share an id are judged each by its own text (rows equal in
both stay or go together); an empty table gives no rows; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_group, byte_slices, cut, hot_keys, look_up, narrow, rolling, small_batches, without_rows, word_hashes
from .graph import connected_components

SHINGLE = 5
NEAR = (4, 5)
SLICE_BYTES = 1 << 20
#: Sets of a cluster that one task verifies.
BLOCK = 256


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    h, n = word_hashes(texts, lower=True)
    every, end = rolling(h, shingle), np.cumsum(n)
    out = []
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        out.append(np.unique(every[a : b - shingle + 1]) if b - a >= shingle else rolling(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42)


def linked(sets: list[np.ndarray], near: tuple[int, int] = NEAR) -> np.ndarray:
    """The first member of each set's component, by links of exact similarity near[0] / near[1] at least."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, dense = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(dense, np.cumsum(size)[:-1])
    mark, label = np.zeros(len(vocabulary), bool), np.full(len(sets), -1)
    rest, values, owner = np.arange(len(sets)), dense, np.repeat(np.arange(len(sets)), size)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        todo = [seed]
        while todo:
            x = todo.pop()
            mark[own[x]] = True
            share = np.bincount(owner[mark[values]], minlength=len(rest))
            mark[own[x]] = False
            hit = rest[(near[1] * share >= near[0] * (size[x] + size[rest] - share)) & (label[rest] < 0)]
            label[hit] = seed
            todo += hit.tolist()
            open_ = label[rest] < 0
            if 2 * open_.sum() <= len(rest):
                stays = open_[owner]
                values, owner = values[stays], (np.cumsum(open_) - 1)[owner[stays]]
                rest = rest[open_]
                if not len(rest):
                    break
    return label


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _signatures(shape: tuple[int, int, int]):  # noqa: ANN202
    """Over rows (doc_id, text, digest): the set of each, with its leaves and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in byte_slices(b.column(1).to_pylist(), SLICE_BYTES):
                sets = shingle_sets(texts)
                ids = _signed(np.fromiter(map(set_id, sets), np.uint64, len(sets)))
                leaf, sketch = simhash.wide_leaves(sets, shape)
                at = pa.array(np.r_[0, np.cumsum([len(x) for x in leaf])].astype(np.int32))
                leaves = pa.ListArray.from_arrays(at, pa.array(np.concatenate(leaf)))
                words = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * simhash.SKETCH), _signed(sketch.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), b.column(2).slice(first, len(sets)), ids, leaves, words], names=["doc_id", "digest", "set", "leaves", "sketch"])

    return run


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each root, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        roots = b.column("root").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(roots)) + 1).tolist(), len(roots)]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            if y > x:
                if held and held[-1].column("root")[0].as_py() != roots[x]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _verify(kind: pa.DataType):  # noqa: ANN202
    """Over rows (root, set, doc_id, text) sorted by root: the sets of each cluster that others are linked to, with the least id among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _clusters(batches):
            ids, texts, docs = rows["set"].to_numpy().view(np.uint64), rows["text"].to_pylist(), rows["doc_id"].to_pylist()
            sets = [s for _, x in byte_slices(texts, SLICE_BYTES) for s in shingle_sets(x)]
            of: dict[int, int] = {}
            for k, s in enumerate(sets):
                if set_id(s) == ids[k]:  # rows that share an id may have other texts
                    of.setdefault(int(ids[k]), k)
            at = sorted(of.values(), key=lambda k: docs[k])
            if len(at) > 1:
                label = linked([sets[k] for k in at])
                many = np.bincount(label, minlength=len(at)) > 1
                found = [(ids[k], docs[at[lead]]) for k, lead in zip(at, label.tolist(), strict=True) if many[lead]]
                if found:
                    yield pa.RecordBatch.from_arrays([_signed(np.array([x for x, _ in found], np.uint64)), pa.array([d for _, d in found], kind)], names=["set", "component_id"])

    return run


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that a document with a smaller id represents."""
    return without_rows(docs, doc_id, text, _represented)


def _near_rep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the set of each row is near that of its cluster's representative."""
    for b in batches:
        text, rep, other = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "rep", "rep_text"))
        of: dict[int, np.ndarray] = {}
        near = []
        for first, some in byte_slices(text, SLICE_BYTES):
            for k, x in enumerate(shingle_sets(some), first):
                if rep[k] not in of:
                    of[rep[k]] = shingle_sets([(other[k] or "").encode()])[0]
                y = of[rep[k]]
                share = len(np.intersect1d(x, y, assume_unique=True))
                near.append(NEAR[1] * share >= NEAR[0] * (len(x) + len(y) - share))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("root")), b.column(b.schema.get_field_index("set")), pa.array(near, pa.bool_())], names=["root", "set", "near"])


def _pairs(_: tuple, t: pa.Table) -> pa.Table:
    """Links (u, v) among the sets of a task's two blocks."""
    ids = t["set"].to_numpy()
    ids, at = np.unique(ids, return_index=True)
    sets = [s for _, x in byte_slices(t["text"].take(pa.array(at)).to_pylist(), SLICE_BYTES) for s in shingle_sets(x)]
    lead = linked(sets)
    on = np.flatnonzero(lead != np.arange(len(ids)))
    return pa.table([pa.array(ids[on]), pa.array(ids[lead[on]])], names=["u", "v"])


def _large(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """set and component_id of the linked sets of clusters of over BLOCK sets.

    Every set is compared with its cluster's representative where it is. Those that are not near it are searched against
    all sets of the cluster, block by block, so that no task holds more than two blocks."""
    reps = texts.where("set = rep").select("root", F.col("text").alias("rep_text"))
    big = sizes.where(F.col("size") > BLOCK)
    hot = hot_keys(big, "root", "size", big.agg(F.sum("size")).first()[0])
    judged = cut(look_up(texts.select("root", "rep", "set", "text"), reps, "root", hot).mapInArrow(narrow(_near_rep), "root long, set long, near boolean"), "judged")
    edges = judged.where("near").join(sizes.select("root", "rep"), "root").select(F.col("set").alias("u"), F.col("rep").alias("v"))
    far = judged.where("not near").select("root", "set")
    if not far.isEmpty():
        blocks = far.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("far_blocks"))
        blocks = cut(blocks.join(sizes, "root").select("root", "far_blocks", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "blocks")
        own = texts.select("root", "set", "text").join(blocks, "root")
        deal = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
        left = own.join(far, ["root", "set"], "left_semi").select("root", "set", "text", deal("far_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        right = own.select("root", "set", "text", F.explode(F.sequence(F.lit(0), F.col("far_blocks") - 1)).alias("i"), deal("blocks").alias("j"))
        edges = edges.unionByName(left.unionByName(right).groupBy("root", "i", "j").applyInArrow(by_group(_pairs), "u long, v long"))
    of = connected_components(edges).withColumnRenamed("node", "set")
    ids = texts.select("set", "doc_id").join(of.withColumnRenamed("root", "part"), "set")
    return ids.groupBy("part").agg(F.min("doc_id").alias("component_id")).join(of.withColumnRenamed("root", "part"), "part").select("set", "component_id")


def _represented(docs: DataFrame) -> DataFrame:
    """doc_id and digest of the rows (doc_id, text, digest) that a document with a smaller id represents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.where("doc_id is not null")
    rows = cut(small_batches(plain).mapInArrow(narrow(_signatures(simhash.forest_shape(plain.count()))), f"doc_id {kind}, digest long, set long, leaves array<int>, sketch array<long>"), "signatures")
    nodes = cut(rows.groupBy("set").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("n")), "sets")
    firsts = nodes.select("set", F.col("first.doc_id").alias("doc_id"), F.col("first.digest").alias("digest"))
    told = cut(rows.join(firsts, ["set", "doc_id", "digest"]).dropDuplicates(["set"]).select("set", "leaves", "sketch"), "leaves")
    clusters = connected_components(simhash.similar_links(told))
    members = firsts.join(clusters, firsts["set"] == clusters["node"]).select("set", "doc_id", "digest", "root")
    members = cut(members, "members")
    sizes = cut(members.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("rep")), "clusters")
    # Members are dealt by document like the texts, at any size: nothing bounds them for a broadcast.
    texts = cut(plain.join(members.hint("merge"), ["doc_id", "digest"]).join(sizes, "root").select("root", "size", "rep", "set", "doc_id", "text"), "texts")
    small = texts.where(F.col("size") <= BLOCK).select("root", "set", "doc_id", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    # Sorted by cluster and read as a stream, a task holds one cluster at a time, however many it has.
    small = small.repartition(F.xxhash64("root", F.lit(1))).sortWithinPartitions("root")
    found = small_batches(small).mapInArrow(narrow(_verify(to_arrow_type(docs.schema["doc_id"].dataType))), f"set long, component_id {kind}")
    large = texts.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        found = found.unionByName(_large(large, sizes))
    named = nodes.join(cut(found, "verified"), "set", "left").where("n > 1 or component_id is not null").select("set", F.coalesce("component_id", "first.doc_id").alias("component_id"))
    hot = hot_keys(nodes, "set", "n", rows.count())
    return look_up(rows.select("doc_id", "digest", "set"), cut(named, "named"), "set", hot).where("component_id < doc_id").select("doc_id", "digest")
