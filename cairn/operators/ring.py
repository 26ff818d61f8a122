"""Weighted consistent hashing: nodes (node, n_replicas), keys (key)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rings of up to so many virtual nodes are broadcast to lookups.
BROADCAST_VNODES = 200_000
#: A hash is a function of a binary column to lower-case hexadecimal digits, as many for every key.
Hash = Callable[[Column], Column]


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def xxh64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))


def build(nodes: DataFrame, hash_: Hash = F.md5) -> DataFrame:
    """(node, replica, pos): the hash of ``node-replica`` for each of a node's replicas."""
    rows = nodes.where("n_replicas > 0").select("node", F.explode(F.sequence(F.lit(0), F.col("n_replicas") - 1)).alias("replica"))
    return rows.withColumn("pos", hash_(F.concat_ws("-", "node", "replica").cast("binary")))


def remove(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes of a ring without those of ``gone`` (node); absent ones are no matter."""
    return nodes.join(gone.select("node"), "node", "left_anti").select(*nodes.columns)


def add(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes of a ring with ``new`` ones, which replace those of their name."""
    return remove(nodes, new).unionByName(new.select(*nodes.columns))


def names(ring: DataFrame) -> DataFrame:
    """The physical nodes that hold a position."""
    return ring.select("node").distinct()


def arcs(ring: DataFrame) -> DataFrame:
    """(node, low, high): positions in (low, high] belong to the node; the first arc of a ring wraps."""
    order = Window.orderBy("pos", "node")
    rows = ring.withColumn("low", F.lag("pos").over(order))
    top = ring.agg(F.max("pos").alias("top"))
    first = rows.where("low is null").crossJoin(F.broadcast(top))  # one row each
    ends = first.select("node", F.lit("").alias("low"), F.col("pos").alias("high")).unionByName(first.select("node", F.col("top").alias("low"), F.lit("g").alias("high")))
    return rows.where("low is not null").select("node", "low", F.col("pos").alias("high")).unionByName(ends)


def lookup(keys: DataFrame, ring: DataFrame, valid: DataFrame | None = None, prefix_chars: int = 3, hash_: Hash = F.md5) -> DataFrame:
    """(key, node): the owner is the first position at or after the key's hash, wrapping round.

    With ``valid`` (node), a key of any other owner has no node.  Arcs are cut
    at the values of the hash's first characters, which turns the range join
    into an equality join with a check: a key meets few arcs.
    """
    n = 16**prefix_chars
    number = lambda c: F.conv(F.substring(c, 1, prefix_chars), 16, 10).cast("int")
    from_ = F.when(F.col("low") == "", 0).otherwise(number("low"))
    to = F.when(F.col("high") == "g", n - 1).otherwise(number("high"))
    owned = arcs(ring) if valid is None else arcs(ring).join(valid.select("node"), "node", "left_semi")
    cut = owned.select("node", "low", "high", F.explode(F.sequence(from_, to)).alias("bin"))
    if ring.count() <= BROADCAST_VNODES:
        cut = F.broadcast(cut)
    hashed = keys.withColumn("_pos", hash_(F.col("key").cast("binary"))).withColumn("_bin", number("_pos"))
    found = hashed.join(cut, (F.col("_bin") == F.col("bin")) & (F.col("_pos") > F.col("low")) & (F.col("_pos") <= F.col("high")), "left")
    return found.select(*keys.columns, "node")


def lookup_tolerant(keys: DataFrame, ring: DataFrame, valid: DataFrame, tolerance: int, hash_: Hash = F.md5) -> DataFrame:
    """(key, node): the first valid node among the owner's position and ``tolerance`` after it, else null.

    Skipped are virtual nodes, not nodes.  The substitute of every position is
    found once, on the ring; keys are then looked up as usual.
    """
    places = ring.withColumn("i", F.row_number().over(Window.orderBy("pos", "node")) - 1)
    n = places.count()
    ahead = places.select("pos", F.col("node").alias("owner"), "replica", F.explode(F.sequence(F.lit(0), F.lit(max(0, min(tolerance, n - 1))))).alias("k"), "i")
    ahead = ahead.withColumn("at", (F.col("i") + F.col("k")) % max(n, 1))
    good = places.join(valid.select("node"), "node", "left_semi").select(F.col("i").alias("at"), "node")
    best = ahead.join(good, "at").groupBy("owner", "replica").agg(F.min_by("node", "k").alias("serves"))
    named = places.select(F.concat_ws("-", "node", "replica").alias("node"), "replica", "pos")
    found = lookup(keys, named, hash_=hash_)
    serves = best.select(F.concat_ws("-", "owner", "replica").alias("vnode"), "serves")
    return found.join(F.broadcast(serves) if n <= BROADCAST_VNODES else serves, F.col("node") == F.col("vnode"), "left").select(*keys.columns, F.col("serves").alias("node"))
