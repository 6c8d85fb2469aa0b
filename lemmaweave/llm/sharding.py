"""Balanced label propagation: documents linked by shared groups are gathered in shards of even counts.

Links are kept as membership of groups (here: equal texts), never as pairs. Shards start from a hash of the id. In
each round, a group's votes are its members' counts by shard; a member wants the shard with the most votes
of its groups (ties: the first in an order of the group that turns with the rounds). A quota bounds each flow between two shards: as many
as come the other way, and beyond that what the capacity of the shard leaves free; a histogram of hash buckets decides who moves, so that no
task sees all movers. Rounds go on while the number of linked pairs that share a shard grows, and end when it has not for TURNS rounds, so that each
order of ties has had its turn; the best labels are kept. That number is whole and bounded, so the rounds end by themselves.

Law `rows`: shard counts are at most one apart. Documents are ranked within their shards, grouped ones
first; the ranks beyond the shard's share fill the free places of other shards in order. So groups are cut
only where capacity demands it. Ranks come from counts of hash buckets and row numbers within a bucket.

DataFrame functions only. Rows that move through a shuffle are ids and hashes, never texts.

Defined cases: a null text is empty, has size 1, and null texts are linked to one another only; empty texts are equal texts;
repeated rows are documents of their own; only the size and the hash of a text move on, so a text of any length is a row like others; equal votes go by an order of the
shards that turns with the rounds, and equal ranks by the row number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, hot_keys, look_up

SHARDS = 8
#: Rounds without a gain after which propagation ends.
TURNS = 4
#: Hash buckets of a shard's movers and of its ranks.
FINE = 1024


def _totals(nodes: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for s, n in nodes.groupBy("shard").count().collect():
        out[s] = n
    return out


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _quotas(wish: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may move from shard to shard: as many as come the other way, and beyond that into free room."""
    n, left = range(len(wish)), list(room)
    out = [[min(wish[i][j], wish[j][i]) for j in n] for i in n]
    for j in n:
        for i in sorted(n, key=lambda i: out[i][j] - wish[i][j]):
            more = min(wish[i][j] - out[i][j], left[j])
            out[i][j] += more
            left[j] -= more
    return out


def propagate(nodes: DataFrame, links: DataFrame, capacity: int, *, hot: list[int] | None = None, shards: int = SHARDS) -> DataFrame:
    """nodes (node, shard) after balanced label propagation over links (node, hub)."""
    best, top, idle = nodes, -1, 0
    for step in count():
        held = _totals(nodes, shards)
        room = [max(0, capacity - n) for n in held]
        votes = links.join(nodes, "node").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        # Every third round leaves out full shards, so that what they cannot hold of a large group gathers elsewhere.
        wish = votes.groupBy("hub").agg(*[F.coalesce(F.sum(F.when(F.col("shard") == s, F.col("n"))), F.lit(0)).alias(f"v{s}") for s in range(shards)])
        wish = cut(wish, "votes")
        together = wish.agg(F.sum(sum(F.col(f"v{s}").cast("decimal(38,0)") * F.col(f"v{s}") for s in range(shards)))).first()[0] or 0
        if together > top:
            if best is not nodes:
                drop_cut(best)
            best, top, idle = nodes, together, 0
        elif (idle := idle + 1) == TURNS:
            break
        mine = look_up(links, wish, "hub", hot or [])
        near = mine.groupBy("node").agg(*[F.sum(f"v{s}").alias(f"v{s}") for s in range(shards)], F.min("hub").alias("hub"))
        here = near.join(nodes, "node")
        rank = [F.struct(F.when(F.lit(held[s] < capacity or step % 3 < 2) | (F.col("shard") == s), F.col(f"v{s}")).otherwise(F.lit(-1)).alias("v"), (-F.pmod(F.lit(s + 5 * step) + F.col("hub"), F.lit(shards))).alias("o"), F.lit(s).alias("s")) for s in range(shards)]
        here = here.select("node", "shard", F.greatest(*rank)["s"].alias("to"))
        movers = cut(here.where("`to` <> shard").withColumn("fine", F.pmod(F.xxhash64("node", F.lit(step)), F.lit(FINE))), "movers")
        wish_ = [[0] * shards for _ in range(shards)]
        for i, j, n in movers.groupBy("shard", "to").count().collect():
            wish_[i][j] = n
        quota = [x for row in _quotas(wish_, room) for x in row]
        pair = F.col("shard") * shards + F.col("to")
        tally = movers.groupBy("shard", "to", "fine").count().withColumn("upto", F.sum("count").over(Window.partitionBy("shard", "to").orderBy("fine")))
        last = [-1] * (shards * shards)
        for p, f in tally.where(F.col("upto") <= F.get(_array(quota), pair)).groupBy(pair.alias("p")).agg(F.max("fine")).collect():
            last[p] = f
        moved = movers.where(F.col("fine") <= F.get(_array(last), pair)).select("node", "to")
        after = cut(nodes.join(moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels")
        drop_cut(movers)
        drop_cut(wish)
        if nodes is not best:
            drop_cut(nodes)
        nodes = after
    return best


def _ranked(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """df (with a column fine) plus at, the place of each row among those of its group: by fine, then order."""
    tally = df.groupBy(group, "fine").count().withColumn("base", F.sum("count").over(Window.partitionBy(group).orderBy("fine")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy(group, "fine").orderBy(*order))
    return df.withColumn("__own", own).join(tally, [group, "fine"]).withColumn("at", F.col("base") + F.col("__own") - 1).drop("base", "__own")


def even_counts(placed: DataFrame, *, shards: int = SHARDS) -> DataFrame:
    """placed (with shard, grouped, order) with shards whose counts are at most one apart, and gapless slots."""
    fine = F.when(F.col("grouped"), F.pmod(F.col("hub"), F.lit(64)) * 16 + F.pmod(F.xxhash64("node"), F.lit(16))).otherwise(FINE + F.pmod(F.xxhash64("node"), F.lit(FINE)))
    ranked = cut(_ranked(placed.withColumn("fine", fine), "shard", [F.col("node")]), "ranked")
    held = _totals(ranked, shards)
    total = sum(held)
    share = [total // shards + (s < total % shards) for s in range(shards)]
    stay = ranked.where(F.col("at") < F.get(_array(share), F.col("shard")))
    # Ranks beyond the share, numbered over all shards, fill the free places, likewise numbered.
    over, free, base, place = [max(0, h - s) for h, s in zip(held, share, strict=True)], [max(0, s - h) for h, s in zip(held, share, strict=True)], [], []
    for s in range(shards):
        base.append(sum(over[:s]) - share[s])
        place.append(sum(free[:s]))
    k = F.col("at") + F.get(_array(base), F.col("shard"))
    move = ranked.where(F.col("at") >= F.get(_array(share), F.col("shard"))).withColumn("__k", k)
    to = sum((F.when(F.col("__k") >= p, 1).otherwise(0) for p, f in zip(place, free, strict=True) if f), F.lit(0)) - 1
    targets = [s for s in range(shards) if free[s]] or [0]
    shard = F.get(F.array(*[F.lit(s) for s in targets]), to)
    move = move.withColumn("__to", shard).withColumn("at", F.col("__k") - F.get(_array(place), F.col("__to")) + F.get(_array(held), F.col("__to"))).withColumn("shard", F.col("__to")).drop("__k", "__to")
    return stay.unionByName(move)


def shard_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document, under the law rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.when(F.col(text).isNull(), F.xxhash64(F.lit("null text"))).otherwise(F.xxhash64(body, F.length(body)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), digest.alias("hub"), F.monotonically_increasing_id().alias("node"))
    rows = cut(rows, "nodes")
    groups = cut(rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    total = rows.count()
    hot = hot_keys(groups, "hub", "n", total)
    links = cut(look_up(rows.select("node", "hub"), groups.select("hub"), "hub", hot), "links")
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")
    share = total // shards
    capacity = share + share // 32  # what is over the share in the end gives way in even_counts, ungrouped documents first
    labels = propagate(cut(links.select("node", start), "labels"), links, capacity, shards=shards, hot=hot)
    placed = rows.join(labels.withColumnRenamed("shard", "label"), "node", "left").select("doc_id", "size", "text_crc32", "hub", "node", F.col("label").isNotNull().alias("grouped"), F.coalesce("label", start).alias("shard"))
    out = even_counts(placed, shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("at").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
