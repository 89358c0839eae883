"""Connected components by joins: large-star and small-star rounds until no edge changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import durable


def _nearest(edges: DataFrame) -> DataFrame:
    """Per node, the smallest of itself and its neighbours. ``edges`` holds both directions."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the smallest: the larger ones of every node (large star) or the smaller ones and itself (small star).

    Only minima are grouped, and they combine before the shuffle; the edges of a node never meet in one task.
    """
    if small:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = _both(edges)
        out = both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges`` ``(u, v)``; a component's name is its smallest node.

    Every round is written to the shared folder, so lineage stays short. Loops and repeated edges do no harm; no edges, no rows.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = durable(_star(_star(now, small=False), small=True))
        after = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if after == mark:
            break
        mark = after
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
