"""SimHash near-duplicates, linked through a forest of vantage-point trees.

Fingerprints: one narrow map. Equal fingerprints are one node from then on.

Search, first levels: 64-bit fingerprints lie 32 +- 4 bits apart, so a tree over the whole distance visits three
quarters of what is below each vantage point at radius 4 (measured in the README). The first levels therefore measure
the distance under a mask. With the bits dealt to radius + c blocks, two fingerprints within the radius agree on
at least c blocks, and the masks of c blocks are one tree each: some tree sees them at distance 0. At radius 0 the
triangle bound leaves one branch whatever the vantage points are, namely the fingerprints with equal masked bits, so
these levels are one hash of the masked bits and each fingerprint is sent once to each tree. c follows from the number of distinct
fingerprints alone: more blocks keep the leaves small as the corpus grows.

Search, within a leaf, on whole distances: a leaf of over LEAF fingerprints is cut into shells by the distance d to
its vantage point. A fingerprint is searched in its own shell and, as a guest, in the shells that its boundary zone
of d to d + radius overlaps; by the triangle bound no other shell further out can hold a neighbour. In a shell, points are
ordered by their distance to a vantage point of its own, and only a window of 2 * radius + 1 distances is compared. A
shell of one distance that is still too large is dealt to blocks and each pair of blocks is searched. A search
yields a spanning forest of its links, so a large group of near copies costs a row a member, not a row a pair.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; rows that repeat
or share an id have their own row in the result; a null id never names a component unless all its ids are null;
a text of any length is one fingerprint, made by slices of words; bits set in exactly half the shingles are 0, and of equal ids in a component any row may name it;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, cut, hot_keys, int_partitions, look_up, mix, narrow, without_rows
from .graph import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
LEAF = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        line = b" ".join(words)
        n = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(n + 1) - 1
        parts = [line[a:b] for a, b in zip((end - n)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_digest  # big-endian
    ones = np.zeros(64, np.int64)
    for at in range(0, len(parts), 1 << 13):
        h = np.frombuffer(b"".join([digest(p, SEED) for p in parts[at : at + (1 << 13)]]), np.uint8)
        ones += np.unpackbits(h).reshape(-1, 64).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *keep).mapInArrow(narrow(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long{kinds}")


def masks_for(n: int, radius: int, leaf: int = LEAF) -> list[int]:
    """Masks of the forest: c of radius + c blocks, with the least c that keeps a leaf of n random fingerprints under leaf."""
    for c in range(1, 9):
        blocks = radius + c
        edges = [64 * k // blocks for k in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        if n <= leaf << (64 // blocks * c - 1) or c == 8:
            return [sum(x) for x in combinations(parts, c)]
    raise AssertionError


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def leaves(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """leaf and fp: each fingerprint in its leaf of each tree. Distance 0 under a mask is equality of the masked bits."""
    of = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)]))
    return nodes.select("fp", of.alias("leaf"))


def shards(routed: DataFrame, radius: int, leaf: int) -> DataFrame:
    """leaf, shard and fp: leaves of over leaf fingerprints are cut into shells of distances to their vantage point, the least fingerprint.

    A fingerprint belongs to the shell of its distance d and is also a guest of the shells that reach into
    d + 1 to d + radius. By the triangle bound no other shell holds a neighbour further out."""
    sizes = cut(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("vantage")).where("n > 1"), "leaves")
    small = routed.join(sizes.where(F.col("n") <= leaf).select("leaf"), "leaf").select("leaf", F.lit(0).alias("shard"), "fp")
    large = sizes.where(F.col("n") > leaf)
    if large.isEmpty():
        return small
    far = cut(routed.join(large.select("leaf", "vantage"), "leaf").select("leaf", "fp", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))).alias("d")), "distances")
    tally = far.groupBy("leaf", "d").count()
    before = F.sum("count").over(Window.partitionBy("leaf").orderBy("d")) - F.col("count")
    shell = tally.select("leaf", "d", F.floor(before / leaf).cast("int").alias("shard"))  # at most 65 rows a leaf
    reach = F.explode(F.sequence(F.col("d") - radius, F.col("d")))
    at = shell.select("leaf", "shard", reach.alias("d")).distinct()  # from which distances a shell has members and guests
    return small.unionByName(far.join(at, ["leaf", "d"]).select("leaf", "shard", "fp"))


def links_within(fp: np.ndarray, radius: int, other: np.ndarray | None = None) -> np.ndarray:
    """A spanning forest of the links among fp, or between fp and other: rows of two fingerprints.

    Points are ordered by their distance to a vantage point, so that only those whose distances differ by the
    radius at most are compared. Many links are thinned by a walk that asks, for each point it reaches, only
    the points that it has not reached."""
    pts = np.concatenate([fp, other]) if other is not None else fp
    side = np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(pts) - len(fp), np.int8)])
    far = np.bitwise_count(pts ^ pts[0]).astype(np.int64) if len(pts) else np.empty(0, np.int64)
    order = np.argsort(far, kind="stable")
    pts, side, far = pts[order], side[order], far[order]
    waiting = np.ones(len(pts), bool)
    at = np.arange(65)
    lo, hi = np.searchsorted(far, at - radius, side="left"), np.searchsorted(far, at + radius, side="right")
    # Few links: each of them. Blocks of rows against the columns that the bound leaves.
    out: list[np.ndarray] = []
    for a in range(0, len(pts), 256):
        rows = pts[a : a + 256]
        b = hi[far[min(a + 256, len(pts)) - 1]]
        near = np.bitwise_count(rows[:, None] ^ pts[None, a:b]) <= radius
        near &= np.arange(b - a)[None, :] > np.arange(len(rows))[:, None]
        if other is not None:
            near &= side[a : a + 256][:, None] != side[None, a:b]
        i, j = np.nonzero(near)
        if i.size:
            out.append(np.stack([rows[i], pts[a:b][j]], 1))
            if sum(map(len, out)) > 4 * len(pts):
                break
    else:
        return np.concatenate(out) if out else np.empty((0, 2), np.uint64)
    out = []
    for seed in range(len(pts)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        todo = [seed]
        while todo:
            x = todo.pop()
            a, b = lo[far[x]], hi[far[x]]
            near = waiting[a:b] & (np.bitwise_count(pts[a:b] ^ pts[x]) <= radius)
            if other is not None:
                near &= side[a:b] != side[x]
            found = np.flatnonzero(near) + a
            if found.size:
                waiting[found] = False
                out.append(np.stack([np.full(found.size, pts[x]), pts[found]], 1))
                todo += found.tolist()
    return np.concatenate(out) if out else np.empty((0, 2), np.uint64)


def _search(radius: int):  # noqa: ANN202
    """Over rows (task, leaf, shard, one, two, own, fp): within block one of a shard, or between its blocks one and two."""

    def run(_: tuple, t: pa.Table) -> pa.Table:
        cols = [t[c].to_numpy() for c in ("leaf", "shard", "one", "two", "own")]
        fp = t["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, *cols[::-1]))
        fp, (leaf, shard, one, two, own) = fp[order], (c[order] for c in cols)
        new = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in (leaf, shard, one, two)], 0)])
        out = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(fp)], strict=True):
            if b - a > 1:
                k = a + int(np.searchsorted(own[a:b], own[a], side="right"))
                out.append(links_within(fp[a:b], radius) if one[a] == two[a] else links_within(fp[a:k], radius, fp[k:b]))
        e = np.concatenate(out).view(np.int64) if out else np.empty((0, 2), np.int64)
        return pa.table([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["u", "v"])

    return run


def near_links(nodes: DataFrame, *, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v) that connect exactly what the links within the radius connect, among distinct fingerprints (fp)."""
    placed = cut(shards(leaves(nodes, masks_for(nodes.count(), radius, leaf)), radius, leaf), "shards")
    sizes = cut(placed.groupBy("leaf", "shard").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("parts"), F.count(F.lit(1)).alias("n")), "sizes")
    # Shells of one distance may still be too large: their fingerprints are dealt to blocks, and each pair of blocks is searched.
    dense = sizes.where("parts > 1").select("leaf", "shard", "parts")
    dealt = placed.join(dense, ["leaf", "shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("one"), F.greatest(k, F.col("own")).alias("two")))
    work = dealt.select("leaf", "shard", "fp", "own", F.explode(pairs).alias("p")).select("leaf", "shard", "fp", "own", "p.one", "p.two")
    # Small shards share a task of about two leaves' rows; a block pair of a large one has its own.
    rows = sizes.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0]
    n = max(int_partitions(nodes, 12), -(-rows // (2 * leaf)))
    work = work.withColumn("task", F.pmod(F.xxhash64("leaf", "shard", "one", "two"), F.lit(n)))
    return work.groupBy("task").applyInArrow(by_group(_search(radius)), "u long, v long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of each document."""
    rows = _named(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _named(fingerprinted: DataFrame, radius: int) -> DataFrame:
    """Rows of doc_id and fp, and any others, with component_id."""
    rows = cut(fingerprinted, "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = connected_components(near_links(nodes, radius=radius))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(linked.select("fp", "root"), "fp", "left").join(least, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    named = cut(named, "named")
    return look_up(rows, named, "fp", hot_keys(nodes, "fp", "n", rows.count()))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without those that a document with a smaller id represents. Rows are told apart by id and text: rows
    equal in both stay or go together; rows with a null id stay."""
    return without_rows(docs, doc_id, text, lambda rows: _named(fingerprints(rows, shingle=shingle, keep=("digest",)), radius).where("component_id < doc_id"))


# ---- wide fingerprints: links of sets by similarity --------------------------------------------
#
# Sets of similarity 0.8 differ in 15 % of the bits of their fingerprints (18.75 % where one has four members and the other five), too many for
# masks of 64 bits. So a set has as many bits as the forest asks for: each tree has a mask of its own bits, at distance 0 as above, and the
# leaves are searched by the whole distance over the first SKETCH words.

SKETCH = 4
#: Of 64 * SKETCH bits. At similarity 0.8, 39 differ (5.7 standard deviation), 48 (6.2) in the smallest sets; of unlike sets, 128 (8).
WIDE_RADIUS = 80
#: Members of a leaf of unlike sets, and of a leaf that one task searches.
WIDE_LEAF, WIDE_BLOCK = 512, 8192
WORDS = [f"w{k}" for k in range(SKETCH)]
#: Trees whose vantage points name sets; bits of a cell, in the last word, which these trees do not ask.
FIRST, CELL = 4, 12
#: The share of pairs of similarity 0.8 that meet in no leaf; agreement of a bit there, for sets of more than FEW members and for fewer.
MISSED, FEW = 5e-8, 32
AGREE, AGREE_FEW = 1 - math.acos(8 / 9) / math.pi, 0.8125


def forest_shape(n: int) -> tuple[int, int, int]:
    """Bits of a mask, trees, and trees for sets of FEW members at most, for n sets."""
    k = min(20, max(4, (n // WIDE_LEAF).bit_length()))
    trees, more = (math.ceil(math.log(MISSED) / math.log(1 - p**k)) for p in (AGREE, AGREE_FEW))
    return k, trees, more


def wide_bits(s: np.ndarray, words: int) -> np.ndarray:
    """64 * words fingerprint bits of a set of 64-bit hashes: 1 if set in over half of them."""
    salt = mix(np.arange(1, words + 1, dtype=np.uint64))
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(s), 255):
        ones += np.unpackbits(mix(s[at : at + 255, None] ^ salt).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return (2 * ones > len(s)).astype(np.uint8)


def wide_leaves(sets: list[np.ndarray], shape: tuple[int, int, int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The leaves of each set, one a tree, and the first SKETCH words of its fingerprint."""
    k, trees, more = shape
    words, power = max(SKETCH, -(-k * more // 64)), 1 << np.arange(k)
    leaf, sketch = [], np.empty((len(sets), SKETCH), np.uint64)
    for i, s in enumerate(sets):
        bits, t = wide_bits(s, words), more if len(s) <= FEW else trees
        leaf.append(((np.arange(t) << k) | bits[: t * k].reshape(t, k) @ power).astype(np.int32))
        sketch[i] = np.packbits(bits[: 64 * SKETCH]).view(np.uint64)
    return leaf, sketch


def _far(pts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distances of each point of x (rows) to each of pts."""
    out = np.bitwise_count(x[:, :1] ^ pts[:, 0]).astype(np.uint16)
    for w in range(1, pts.shape[1]):
        out += np.bitwise_count(x[:, w : w + 1] ^ pts[:, w])
    return out


def wide_links(pts: np.ndarray, radius: int, own: np.ndarray | None = None) -> np.ndarray:
    """links_within() for fingerprints of several words, as places in pts. own: the block of each, if only links between two blocks are asked for."""
    far = _far(pts, pts[:1])[0].astype(np.int64)
    order = np.argsort(far, kind="stable")
    pts, far, own = pts[order], far[order], None if own is None else own[order]
    hi, out = np.searchsorted(far, far + radius, side="right"), []
    for a in range(0, len(pts), 256):
        b = hi[min(a + 256, len(pts)) - 1]
        near = _far(pts[a:b], pts[a : a + 256]) <= radius
        near &= np.arange(b - a)[None, :] > np.arange(len(near))[:, None]
        if own is not None:
            near &= own[a : a + 256][:, None] != own[None, a:b]
        i, j = np.nonzero(near)
        out.append(np.stack([order[a + i], order[a + j]], 1))
        if sum(map(len, out)) > 4 * len(pts):
            break
    else:
        return np.concatenate(out)
    out, waiting = [], np.ones(len(pts), bool)  # many links: a walk asks only those that it has not reached
    for seed in range(len(pts)):
        todo = [seed] if waiting[seed] else []
        waiting[seed] = False
        while todo:
            x, rest = todo.pop(), np.flatnonzero(waiting)
            near = _far(pts[rest], pts[x : x + 1])[0] <= radius
            found = rest[near if own is None else near & (own[rest] != own[x])]
            waiting[found] = False
            out.append(np.stack([np.full(len(found), order[x]), order[found]], 1))
            todo += found.tolist()
    return np.concatenate(out)


def spanned(n: int, links: np.ndarray) -> np.ndarray:
    """The least place that each of n places is connected to by links, rows of two places."""
    root, (i, j) = np.arange(n), links.T
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _wide_search(_: tuple, t: pa.Table) -> pa.Table:
    """Over rows (task, leaf, part, own, name, w0 to w3): what is linked within a leaf, or between the two sides of a part of it, as one
    edge from each name to the least that it is connected to in the task, however many leaves and links connect them."""
    leaf, part, own = (t[c].to_numpy() for c in ("leaf", "part", "own"))
    order = np.lexsort((own, part, leaf))
    leaf, part, own = leaf[order], part[order], own[order]
    names, at = np.unique(t["name"].to_numpy()[order], return_inverse=True)
    pts = np.stack([t[w].to_numpy() for w in WORDS], 1)[order].view(np.uint64)
    new = np.flatnonzero(np.r_[True, (np.diff(leaf) != 0) | (np.diff(part) != 0)])
    out = [np.empty((0, 2), np.int64)]
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
        if b - a > 1:
            out.append(at[a:b][wide_links(pts[a:b], WIDE_RADIUS, own[a:b] if part[a] else None)])
    root = spanned(len(names), np.concatenate(out))
    on = np.flatnonzero(root != np.arange(len(names)))
    return pa.table([pa.array(names[on]), pa.array(names[root[on]])], names=["u", "v"])


def _vantages(rows: DataFrame) -> DataFrame:
    """leaf, its number of rows n, and v (name, w0 to w3), the vantage point of each leaf: the least name in the commonest cell of CELL further bits, where the near copies of a leaf are, if it has many."""
    cells = rows.groupBy("leaf", F.shiftrightunsigned(WORDS[-1], 64 - CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", *WORDS)).alias("v"))
    return cells.groupBy("leaf").agg(F.sum("n").alias("n"), F.max(F.struct("n", "v"))["v"].alias("v"))


def _near_vantage() -> Column:
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"v.{w}"))) for w in WORDS), F.lit(0)) <= WIDE_RADIUS


def _hubs(told: DataFrame) -> DataFrame:
    """set, hub and hubs: the vantage points of the leaves of the first trees that a set is within WIDE_RADIUS of, and the least of them."""
    rows = told.select(F.col("set").alias("name"), *WORDS, F.explode(F.slice("leaves", 1, FIRST)).alias("leaf"))
    seen = cut(_vantages(rows), "vantages")
    hot = hot_keys(seen, "leaf", "n", seen.agg(F.sum("n")).first()[0] or 0)
    near = look_up(rows, seen.select("leaf", "v"), "leaf", hot).where(_near_vantage()).select(F.col("name").alias("set"), F.col("v.name").alias("hub"))
    return near.groupBy("set").agg(F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs"))


def _in_parts(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """rows with part and own, the edges of what is near the vantage point of a large leaf, and how many rows there are more.

    Whoever is near the vantage point is linked to it where it is. The others are searched against all of the leaf, by pairs of blocks (parts)."""
    seen = cut(_vantages(rows.join(F.broadcast(large), "leaf", "left_semi")), "vantages")
    far = rows.join(F.broadcast(seen), "leaf").where(~_near_vantage()).groupBy("leaf").agg(F.count(F.lit(1)).alias("far"))
    blocks = lambda n: F.ceil(F.col(n) / WIDE_BLOCK).cast("int")
    plan = cut(seen.join(far, "leaf", "left").fillna(0, ["far"]).select("leaf", "v", "n", "far", blocks("n").alias("blocks"), blocks("far").alias("far_blocks")), "parts")
    more = plan.agg(F.sum(F.col("n") * F.col("far_blocks") + F.col("far") * F.col("blocks"))).first()[0] or 0
    rows = rows.join(F.broadcast(plan.select("leaf", "v", "blocks", "far_blocks")), "leaf", "left")
    edges = rows.where(F.col("v").isNotNull() & _near_vantage()).select(F.col("name").alias("u"), F.col("v.name").alias("v")).distinct()
    deal = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    at = lambda own, i, j: F.struct(F.lit(own).alias("own"), (i * F.col("blocks") + j + 1).alias("part"))
    every = F.transform(F.sequence(F.lit(0), F.col("far_blocks") - 1), lambda i: at(0, i, deal("blocks")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: at(1, deal("far_blocks"), j))
    parts = F.when(F.col("v").isNull(), F.array(F.struct(F.lit(0).alias("own"), F.lit(0).alias("part")))).when(_near_vantage(), every).otherwise(F.concat(every, others))
    dealt = rows.where("v is null or far_blocks > 0").withColumn("p", F.explode(parts)).select("leaf", "name", *WORDS, "p.own", "p.part")
    return dealt, edges, more


def similar_links(sets: DataFrame) -> DataFrame:
    """Edges (u, v) among rows (set, leaves, sketch), see wide_leaves, that connect exactly what the links within WIDE_RADIUS in a leaf of the forest connect.

    Near copies meet in most of the trees, each time with others. So the first trees name a set by a hub, the vantage point of its leaf, and all trees are searched for
    links between names: a large group costs an edge for each of its sets, and those among its hubs, not one a tree."""
    counts = cut(sets.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf sizes")
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    told = sets.select("set", "leaves", *[F.get("sketch", F.lit(k)).alias(w) for k, w in enumerate(WORDS)])
    hubs = cut(_hubs(told), "hubs")
    edges = hubs.select(F.col("set").alias("u"), F.col("hub").alias("v")).unionByName(hubs.select(F.explode("hubs").alias("u"), F.col("hub").alias("v")).distinct())
    rows = told.join(hubs.select("set", "hub"), "set", "left").select("set", F.coalesce("hub", "set").alias("name"), *WORDS, F.explode("leaves").alias("leaf"))
    if most > WIDE_BLOCK:
        rows, near, more = _in_parts(rows, counts.where(F.col("n") > WIDE_BLOCK).select("leaf"))
        edges, total = edges.unionByName(near), total + more
    else:
        rows = rows.select("leaf", "name", *WORDS, F.lit(0).alias("own"), F.lit(0).alias("part"))
    n = max(int_partitions(sets, 12), -(-total // (1 << 17)))
    found = rows.withColumn("task", F.pmod(F.xxhash64("leaf", "part"), F.lit(n))).groupBy("task").applyInArrow(by_group(_wide_search), "u long, v long")
    return edges.where("u <> v").unionByName(found)
