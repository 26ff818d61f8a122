"""Connected components of an edge table, by alternating star contractions.

Hubs are met apart.  A node with more than its bound of edges is one of at most
``MOST_HUBS`` (the bound is at least the edges' ends divided by that), so a
broadcast takes the least neighbour of each hub to its edges where they lie;
only edges of other nodes are dealt by node, and no node fills a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged

#: Edges from which a node may count as a hub, and the most hubs that are broadcast.
HUB, MOST_HUBS = 64, 50_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _with_least(edges: DataFrame, least: DataFrame, ends: int, some: Column | None = None) -> DataFrame:
    """(u, v, m): edges (of ``some``) with the least of their node; ``least`` has (c, m, n), n the node's edges."""
    bound = max(HUB, ends // MOST_HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bound).select(F.col("c").alias("hub"), F.col("m").alias("hub_m")))
    rows = edges if some is None else edges.where(some)
    met = rows.join(hubs, F.col("u") == F.col("hub"), "left")
    rest = met.where("hub is null").select("u", "v").join(least.where(F.col("n") <= bound).select("c", "m"), F.col("u") == F.col("c"))
    return met.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour above a node moves to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least("c", F.min("v")).alias("m"), F.count("*").alias("n"))
    moved = _with_least(both, least, 2 * n, F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour below a node, and the node, move to the least of them."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node but the least of its component, which is v.

    ``edges`` has comparable columns u > v, without nulls; repeats are allowed.
    Each half of a round is an aggregation and a join on a node, written to the
    shared folder; rounds grow with the logarithm of the longest path.  Only a
    count and a checksum of the edges come to the driver.  No edges: no rows.
    """
    now = staged(edges.select("u", "v").distinct(), "edges")
    mark = _signature(now)
    while True:
        large = staged(_large_star(now, mark[0]), "edges")
        after = staged(_small_star(large, mark[0]), "edges")
        dropped(large)
        if (new := _signature(after)) == mark:
            dropped(now)
            return after
        dropped(now)
        now, mark = after, new
