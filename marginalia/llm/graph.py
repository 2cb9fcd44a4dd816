"""Connected components by alternating large-star and small-star steps, without collecting anything."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces links by stars that join the same nodes: at most one link for each node."""
    if len(a) < 2:
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


#: Rows of one key that a join deals to one task, at least; and the share of all rows (one in so many) above it.
HUB, HUB_SHARE = 256, 50_000


def join_hubs(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each ``key`` and how many rows it meets as n.

    Keys that meet over ``HUB`` rows and over one in ``HUB_SHARE`` of ``total`` are broadcast, so a hub's rows stay
    where they are; there are fewer than ``HUB_SHARE`` such keys at any size, if the n add up to ``total`` at most.
    """
    most = max(HUB, total // HUB_SHARE)
    hubs, rest = values.where(F.col("n") > most).drop("n"), values.where(F.col("n") <= most).drop("n")
    with_hubs = rows.join(F.broadcast(hubs), key)
    return rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key).unionByName(with_hubs)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node with a link, the smallest node it reaches; a root of its own is listed too.

    Each round halves path lengths and is written to the checkpoint folder, so a lost executor repeats one
    round at most. Minima are pre-aggregated before the shuffle; those of hubs are broadcast back, so a hub's
    links are never dealt to one task. An empty input gives an empty result.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = materialize(edges), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_hubs(both.where("v > u"), least, "u", 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hubs(large, least, "u", now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
