"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import HOT_KEYS, drop_stash, stash


def _stars(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """(u, v, m): each edge from u with the least of u and its neighbours. Edges of a hub (few, and named) stay where they are and
    get its least by broadcast; those of others come together by u."""
    hub = F.col("u").isin(hubs)
    out = (edges.filter(~hub) if hubs else edges).select("u", "v", F.least(F.min("v").over(Window.partitionBy("u")), "u").alias("m"))
    if hubs:
        least = edges.filter(hub).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = out.unionByName(edges.filter(hub).join(F.broadcast(least), "u").select("u", "v", "m"))
    return out


def _state(edges: DataFrame) -> tuple[bool, list[int]]:
    """Whether every node hangs under one other at most and nothing hangs under a node that hangs; and the nodes that over 1/HOT_KEYS
    of the edges touch, 2 * HOT_KEYS at most."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.sum("e.hangs").alias("hangs"), F.sum("e.holds").alias("holds"))
    hot = F.when((F.col("hangs") + F.col("holds")) * HOT_KEYS > edges.count(), F.col("id"))
    left, hubs = nodes.agg(F.count_if((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") > 0))), F.collect_list(hot)).first()
    return left == 0, hubs


def components(edges: DataFrame) -> DataFrame:
    """(node, root), stored, for every node of edges (a, b: long); root is the component's least node. Loops and repeats are harmless.

    Each round hangs every node's larger neighbours, then its smaller ones, under the least of them, and
    is written out; rounds grow with the logarithm of the longest path. Only whether one is left to do and the few hubs reach the driver.
    """
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        done, hubs = _state(now)
        if done:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stash(_stars(both, hubs).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        drop_stash(now)
        # A node has no more edges here than before, so the hubs are among the same.
        stars = _stars(large, hubs)
        now = stash(stars.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_stash(large)
    roots = stash(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    drop_stash(now)
    return roots


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """components of the edges behind `roots` (stored: node, root) and of more edges (stored: a, b), worked out between roots alone."""
    if not edges.take(1):
        return roots
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_")), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
    above = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    own = roots.unionByName(above.select(F.col("root").alias("node"), "root").join(roots.select("node"), "node", "left_anti"))
    return stash(own.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "components")
