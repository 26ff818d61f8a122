"""Reconciliation of replicated per-node state (node, key, value, version)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..folders import written
from ..functions import sizes

MAX_VALUE_BYTES = 500
#: Bytes of a message on the wire, at most.
MTU = 60_000
HEARTBEAT = "heartbeat"
#: Writes of a node that are numbered together.
RANGE = 1 << 16
COLUMNS = ["node", "key", "value", "version"]


class Delta(NamedTuple):
    """What one replica sends another: nodes (node, n) in it, n rows each (0: header alone), and their rows."""

    nodes: DataFrame
    rows: DataFrame


class Exchange(NamedTuple):
    """Both states after a round, and what went over the wire."""

    a: DataFrame
    b: DataFrame
    to_a: Delta
    to_b: Delta


def get(states: DataFrame, node: str, key: str) -> DataFrame:
    """(value, version) of one key of one node; no row if absent."""
    return states.where((F.col("node") == node) & (F.col("key") == key)).select("value", "version")


def nodes(states: DataFrame) -> DataFrame:
    return states.select("node").distinct()


def with_nodes(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """``states`` and, for each wanted node without a row, one of null key and version 0: a node known by name alone."""
    new = wanted.select("node").distinct().join(nodes(states), "node", "left_anti")
    empty = new.select("node", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("version"))
    return states.select(*COLUMNS).unionByName(empty)


def remove_nodes(states: DataFrame, gone: DataFrame) -> DataFrame:
    return states.join(gone.select("node"), "node", "left_anti").select(*states.columns)


def assign_versions(sets: DataFrame) -> DataFrame:
    """Number each node's writes in order of ``seq`` (whole numbers); an unchanged value counts too.

    Writes are numbered within ranges of ``RANGE`` of ``seq``, then moved up
    by what earlier ranges hold, so a node with most of the rows is many tasks.
    """
    ranged = sets.withColumn("_range", F.floor(F.col("seq") / RANGE))
    sums = ranged.groupBy("node", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("node").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("node").alias("_node"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("node", "_range").orderBy("seq"))
    met = ranged.withColumn("_own", own).join(sums, F.col("node").eqNullSafe(F.col("_node")) & (F.col("_range") == F.col("_of")))
    return met.select(*sets.columns, (F.col("_own") + F.col("_before")).cast("long").alias("version"))


def initial_states(pairs: DataFrame) -> DataFrame:
    """States of new nodes from (node, ord, key, value): ``heartbeat`` 0 has version 1, pairs follow in order.

    A repeated key keeps its last value, which has the later version.
    """
    seed = pairs.select("node").distinct().select("node", F.lit(-1).cast("long").alias("ord"), F.lit(HEARTBEAT).alias("key"), F.lit("0").alias("value"))
    rows = seed.unionByName(pairs.select("node", F.col("ord").cast("long"), "key", "value"))
    return latest(assign_versions(rows.withColumnRenamed("ord", "seq")))


def latest(rows: DataFrame) -> DataFrame:
    """The row of the highest version of each (node, key)."""
    best = rows.groupBy("node", "key").agg(F.max(F.struct("version", "value")).alias("b"))
    return best.select("node", "key", F.col("b.value").alias("value"), F.col("b.version").alias("version"))


def beat(states: DataFrame, ticks: DataFrame) -> DataFrame:
    """States after ``ticks`` (node, beats): each beat adds one to ``heartbeat`` and to the node's version."""
    top = states.groupBy("node").agg(F.max("version").alias("top"), F.max(F.when(F.col("key") == HEARTBEAT, F.col("value").cast("long"))).alias("now"))
    beats = ticks.groupBy("node").agg(F.sum("beats").cast("long").alias("beats")).where("beats > 0").join(top, "node", "left")
    none = F.lit(0).cast("long")
    new = beats.select("node", F.lit(HEARTBEAT).alias("key"), (F.coalesce("now", none) + F.col("beats")).cast("string").alias("value"), (F.coalesce("top", none) + F.col("beats")).alias("version"))
    return apply_delta(states, new)


def oversized(rows: DataFrame, limit: int = MAX_VALUE_BYTES) -> DataFrame:
    """Append ``accepted``: the value has at most ``limit`` bytes."""
    return rows.withColumn("accepted", F.coalesce(F.octet_length("value"), F.lit(0)) <= limit)


def digest(states: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """(node, max_version) of nodes that are not dead; a node known by name alone has 0."""
    rows = states if dead is None else remove_nodes(states, dead)
    return rows.groupBy("node").agg(F.coalesce(F.max("version"), F.lit(0)).alias("max_version"))


def syn(states: DataFrame, cluster_id: str, dead: DataFrame | None = None) -> DataFrame:
    """The opening message: (cluster_id, node, max_version)."""
    return digest(states, dead).select(F.lit(cluster_id).alias("cluster_id"), "node", "max_version")


def stale(states: DataFrame, peer: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Rows with a version over the peer's maximum for the node (0 if it has none), of nodes that are not dead."""
    rows = states if dead is None else remove_nodes(states, dead)
    floors = peer.select("node", F.col("max_version").alias("floor"))
    return rows.join(floors, "node", "left").where(F.col("version") > F.coalesce("floor", F.lit(0))).select(*states.columns)


def rank_stale(rows: DataFrame, seed: int | None = None, most: int | None = None) -> DataFrame:
    """(node, stale, place): most stale rows first, ties by node, or by the hash of ``seed`` and node.

    ``most`` keeps the first places only, which needs no sort of all nodes.
    """
    counts = rows.groupBy("node").agg(F.count("*").alias("stale"))
    tie = [] if seed is None else [F.md5(F.concat(F.lit(str(seed)), "node").cast("binary"))]
    order = [F.desc("stale"), *tie, F.asc("node")]
    if most is not None:
        counts = counts.orderBy(*order).limit(most)
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def delta(rows: DataFrame, mtu: int, seed: int | None = None, address_bytes: int = 7) -> Delta:
    """The stale rows that fit in ``mtu`` bytes: nodes by rank, versions ascending, up to the first that does not fit.

    The message starts at ``COUNT`` bytes; ``sizes`` has what nodes and rows
    cost, a null value as an empty one.  A node whose header fits and whose
    first row does not is sent with no rows.  No message of so many bytes can
    hold more nodes than it has headers, or more rows of one node than it has
    bare rows: the rest is cut off before any window sees it.
    """
    header = (sizes.string("node") + address_bytes + sizes.COUNT).alias("header")
    limit, bound = F.lit(mtu), max(mtu, 0)
    most_nodes, most_rows = bound // (2 * sizes.COUNT + address_bytes) + 1, bound // (2 * sizes.COUNT + sizes.VERSION) + 1
    ranked = rank_stale(rows, seed, most_nodes).select("node", "place", header)
    by_version = Window.partitionBy("node").orderBy("version", "key")
    first = rows.withColumn("_k", F.row_number().over(by_version)).where(F.col("_k") <= most_rows)
    sized = first.join(F.broadcast(ranked), "node").withColumn("cost", sizes.key_value("key", "value"))
    totals = ranked.join(sized.groupBy("node").agg(F.sum("cost").alias("all")), "node")
    upto = F.sum(F.col("header") + F.col("all")).over(Window.orderBy("place"))
    # Where a node's rows begin: the cut above only shortens nodes that overrun the message by themselves.
    begun = totals.withColumn("start", F.lit(sizes.COUNT) + upto - F.col("all")).where(F.col("start") <= limit).select("node", "start")
    fits = sized.join(F.broadcast(begun), "node").withColumn("bytes", F.col("start") + F.sum("cost").over(by_version))
    fits = fits.where(F.col("bytes") <= limit).select("node", "key", "value", "version", "bytes")
    sent = begun.join(fits.groupBy("node").agg(F.count("*").alias("n")), "node", "left")
    return Delta(sent.select("node", F.coalesce("n", F.lit(0)).alias("n")), fits)


def budgeted_delta(rows: DataFrame, mtu: int, address_bytes: int = 7) -> DataFrame:
    """The rows of ``delta`` with ``bytes``, the message's length up to and with each."""
    return delta(rows, mtu, address_bytes=address_bytes).rows


def apply_delta(local: DataFrame, sent: DataFrame) -> DataFrame:
    """Last writer wins by (node, key): the higher version, the local row at equal ones."""
    both = local.select(*COLUMNS, F.lit(1).alias("own")).unionByName(sent.select(*COLUMNS, F.lit(0).alias("own")))
    best = both.groupBy("node", "key").agg(F.max(F.struct("version", "own", "value")).alias("b"))
    return best.select("node", "key", F.col("b.value").alias("value"), F.col("b.version").alias("version"))


def receive(local: DataFrame, sent: Delta) -> DataFrame:
    """State after a delta; nodes of which only the header came are known by name."""
    return with_nodes(apply_delta(local, sent.rows), sent.nodes)


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """State of ``a`` after b's answer to its digest, without a byte budget."""
    return apply_delta(a, stale(b, digest(a)))


def exchange(a: DataFrame, b: DataFrame, mtu: int = MTU, clusters: Sequence[str] = ("default-cluster", "default-cluster"), dead_a: DataFrame | None = None, dead_b: DataFrame | None = None, seed: int | None = None) -> Exchange:
    """One round: a's Syn, b's SynAck within what its digest leaves of ``mtu``, a's Ack within ``mtu`` - 1.

    Where cluster names differ b answers BadCluster: states stay, nothing is
    sent.  Each side leaves out nodes that it holds dead.  Messages, each of
    ``mtu`` bytes at most, and a's state are written to the shared folder.
    """
    if clusters[0] != clusters[1]:
        none = Delta(a.select("node").limit(0).select("node", F.lit(0).cast("long").alias("n")), a.select(*COLUMNS).limit(0))
        return Exchange(a, b, none, none)
    sent = lambda d: Delta(written(d.nodes, "sent-nodes"), written(d.rows, "sent-rows"))
    digest_b = written(digest(b, dead_b), "digest")
    left = mtu - int(syn_ack_sizes(digest_b).first()[0])
    to_a = sent(delta(stale(b, digest(a, dead_a), dead_b), max(left, 0), seed))
    after_a = written(receive(a, to_a), "state")
    to_b = sent(delta(stale(after_a.where("key is not null"), digest_b, dead_a), mtu - 1, seed))
    return Exchange(after_a, receive(b, to_b), to_a, to_b)


def nested(states: DataFrame) -> DataFrame:
    """(node, kvs): a map of key to (value, version) for each node.

    A node is one row, as the export asks; ``flattened`` is the way back.
    """
    pairs = F.collect_list(F.struct("key", F.struct("value", "version")))
    return states.groupBy("node").agg(F.map_from_entries(F.array_sort(pairs)).alias("kvs"))


def flattened(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("node", F.explode("kvs").alias("key", "x")).select("node", "key", "x.value", "x.version")


def syn_ack_sizes(peer: DataFrame, address_bytes: int = 7) -> DataFrame:
    """One row: bytes of a reply with this digest and an empty delta."""
    node = sizes.string("node") + address_bytes + sizes.VERSION
    return peer.agg((F.lit(sizes.TAG + 2 * sizes.COUNT) + F.coalesce(F.sum(node), F.lit(0))).cast("long").alias("bytes"))
