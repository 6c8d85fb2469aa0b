"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour; it is one aggregation with map-side combine and
one join. Nodes with a thousandth of all edges or more (at most a thousand) are joined where their edges are, so a hub
never meets in one task. The state is written to shared storage after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, hot_keys, look_up


def _joined(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v), total or fewer, with m, the least neighbour of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return look_up(edges, least.select("u", "m"), "u", hot_keys(least, "u", "n", total))


def _stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (u, v) in both directions (large) or from the greater to the smaller end."""
    if large:
        near = _joined(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))), 2 * total)
        out = near.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        down = _joined(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), total)
        out = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of an edge (u, v); root is the least node of its component."""
    now, before = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"), None
    total = now.count()
    while total:
        after = cut(_stars(cut(_stars(now, True, total), "stars"), False, total), "edges")
        sign = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_cut(now)
        now, total = after, sign[0]
        if sign == before:
            break
        before = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
