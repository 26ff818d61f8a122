"""Accrual liveness from heartbeats (node, t): t in seconds of event time."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import ranged
from .replica import remove_nodes

#: Ticks whose sets are compared together.
TICKS = 1 << 12


@dataclass(frozen=True)
class LivenessConfig:
    """Seconds; ``window`` is in samples."""

    threshold: float = 8.0
    window: int = 1000
    max_interval: float = 10.0
    initial_interval: float = 5.0
    grace: float = 86_400.0

    def __post_init__(self) -> None:
        if self.window < 1:
            raise ValueError("a window holds at least one sample")


def detect(local: DataFrame, delta: DataFrame) -> DataFrame:
    """Nodes (node, max_version) of ``delta`` that are over the local maximum (0 if unknown)."""
    known = local.select("node", F.col("max_version").alias("known"))
    return delta.join(known, "node", "left").where(F.col("max_version") > F.coalesce("known", F.lit(0))).select("node", "max_version")


def intervals(beats: DataFrame, conf: LivenessConfig) -> DataFrame:
    """(node, t, sample): time since the last beat; over-long ones become the initial interval."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("node").orderBy("t"))
    sample = F.when(F.col("gap") <= conf.max_interval, F.col("gap")).otherwise(F.lit(conf.initial_interval))
    return beats.withColumn("gap", gap).where("gap is not null").select("node", "t", sample.alias("sample"))


def rolling_mean(samples: DataFrame, conf: LivenessConfig) -> DataFrame:
    """Append ``mean`` of a node's last ``window`` samples."""
    rows = Window.partitionBy("node").orderBy("t").rowsBetween(1 - conf.window, 0)
    return samples.withColumn("mean", F.avg("sample").over(rows))


def phi(beats: DataFrame, as_of: DataFrame, conf: LivenessConfig) -> DataFrame:
    """(node, last, mean, phi): seconds since the last beat over the mean; null without a sample.

    ``as_of`` is one row with column ``now``.
    """
    means = rolling_mean(intervals(beats, conf), conf).groupBy("node").agg(F.max_by("mean", "t").alias("mean"))
    last = beats.groupBy("node").agg(F.max("t").alias("last"))
    joined = last.join(means, "node", "left").crossJoin(F.broadcast(as_of.select("now")))  # one row
    return joined.select("node", "last", "mean", ((F.col("now") - F.col("last")) / F.col("mean")).alias("phi"))


def classify(phis: DataFrame, conf: LivenessConfig) -> DataFrame:
    """Append ``status``: dead over the threshold, live up to it, unknown without phi."""
    status = F.when(F.col("phi") > conf.threshold, "dead").when(F.col("phi").isNotNull(), "live").otherwise("unknown")
    return phis.withColumn("status", status)


def collect_garbage(dead: DataFrame, as_of: DataFrame, conf: LivenessConfig) -> DataFrame:
    """(node, dead_at, removed): dead for the grace period or longer."""
    return dead.crossJoin(F.broadcast(as_of.select("now"))).select("node", "dead_at", (F.col("now") - F.col("dead_at") >= conf.grace).alias("removed"))


def ready(live: DataFrame, states: DataFrame, predicate: str) -> DataFrame:
    """Live nodes whose state has a row for which ``predicate`` holds."""
    return live.select("node").join(states.where(predicate).select("node"), "node", "left_semi")


def change_feed(ticks: DataFrame) -> DataFrame:
    """(tick, nodes): the sorted set of each tick (null nodes: empty) where it differs from the tick before.

    Ticks are whole numbers.  They are compared within ranges of ``TICKS``;
    the first of a range meets the last of the range before it, one row each.
    """
    sets = ticks.groupBy("tick").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("nodes"))
    met = ranged.with_previous(sets, [], "tick", F.col("nodes"), "before", TICKS)
    return met.where(~F.col("nodes").eqNullSafe(F.col("before"))).select("tick", "nodes")


@dataclass(frozen=True)
class Schedule:
    """Evaluation times start, start + every, ... up to ``until`` (seconds)."""

    start: float
    every: float
    until: float

    def __post_init__(self) -> None:
        if self.every <= 0:
            raise ValueError("ticks are some time apart")

    def at(self, k: int) -> float:
        return self.start + k * self.every

    def first(self, t: float) -> int:
        """Number of the first tick at ``t`` or later."""
        k = max(0, math.ceil((t - self.start) / self.every))
        while k > 0 and self.at(k - 1) >= t:
            k -= 1
        while self.at(k) < t:
            k += 1
        return k


class Node:
    """One node's window of samples, and what evaluations have made of it."""

    def __init__(self, conf: LivenessConfig):
        self.conf, self.samples, self.total = conf, deque(), 0.0
        self.last: float | None = None
        self.status, self.dead_at, self.epoch = "unknown", None, 0

    @property
    def mean(self) -> float | None:
        return self.total / len(self.samples) if self.samples else None

    def beat(self, t: float) -> float | None:
        """The sample that a heartbeat adds; the first of an epoch adds none."""
        sample = None
        if self.last is not None:
            gap = t - self.last
            sample = gap if gap <= self.conf.max_interval else self.conf.initial_interval
            if len(self.samples) == self.conf.window:
                self.total -= self.samples.popleft()
            self.samples.append(sample)
            self.total += sample
        self.last = t
        return sample

    def phi(self, now: float) -> float | None:
        """None without a sample, or where all samples are 0."""
        return (now - self.last) / self.mean if self.mean else None

    def until(self, schedule: Schedule, end: float) -> Iterator[tuple[float, str, float | None, int]]:
        """(tick, status, phi, epoch) of what changes at ticks from the last beat on, before ``end``.

        Between beats phi only grows, so the tick of a death is found without
        visiting those before it.
        """
        at, threshold = schedule.at, self.conf.threshold
        k = schedule.first(self.last if self.last is not None else schedule.start)
        if self.mean and at(k) < end:
            now = self.phi(at(k))
            if now <= threshold:
                if self.status != "live":
                    self.status, self.dead_at = "live", None
                    yield at(k), "live", now, self.epoch
                k = max(k, schedule.first(self.last + threshold * self.mean) - 1)
                while at(k) < end and self.phi(at(k)) <= threshold:
                    k += 1
            if at(k) < end:
                now = self.phi(at(k))
                # The window starts anew with the next beat.
                self.status, self.dead_at, self.last, self.total = "dead", at(k), None, 0.0
                self.samples.clear()
                yield at(k), "dead", now, self.epoch
                self.epoch += 1
        if self.status == "dead":
            j = max(k, schedule.first(self.dead_at + self.conf.grace) - 1)
            while at(j) - self.dead_at < self.conf.grace:
                j += 1
            if at(j) < end:
                self.status, self.dead_at = "removed", None
                yield at(j), "removed", None, self.epoch


def transitions(beats: DataFrame, schedule: Schedule, conf: LivenessConfig) -> DataFrame:
    """(node, tick, status, phi, epoch): every change that evaluations at the ticks make of a node.

    Live up to the threshold, dead over it: the window is dropped and a new
    epoch begins, in which a node stays dead until it has a sample again;
    removed when dead for the grace period.  A beat at a tick comes before it.
    Each death depends on those before it, so a node's beats are read in order,
    as a stream with one window in memory.  Null nodes and times are not read.
    """
    kind = beats.schema["node"].dataType
    rows = beats.where("node is not null and t is not null").select("node", F.col("t").cast("double"))
    rows = rows.repartition("node").sortWithinPartitions("node", "t")
    schema = T.StructType([T.StructField("node", kind), *(T.StructField(n, t) for n, t in (("tick", T.DoubleType()), ("status", T.StringType()), ("phi", T.DoubleType()), ("epoch", T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, node = None, None
        past = math.nextafter(schedule.until, math.inf)
        for batch in batches:
            out: list[tuple] = []
            for who, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if who != name:
                    if node is not None:
                        out += [(name, *x) for x in node.until(schedule, past)]
                    name, node = who, Node(conf)
                elif node is not None:
                    out += [(name, *x) for x in node.until(schedule, min(t, past))]
                node.beat(t)
            yield pack(out, batch.schema)
        if node is not None:
            yield pack([(name, *x) for x in node.until(schedule, past)], batch.schema)

    def pack(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
        kinds = (like.field(0).type, pa.float64(), pa.string(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)


class Membership(NamedTuple):
    """What evaluations leave: changes of nodes, changes of the ready set, and states without removed nodes."""

    changes: DataFrame
    ready: DataFrame
    states: DataFrame


def update_nodes(states: DataFrame, beats: DataFrame, schedule: Schedule, conf: LivenessConfig, self_node: object, predicate: str | None = None) -> Membership:
    """Liveness of all nodes but oneself, the ready set's feed and the removal of long-dead nodes.

    ``ready`` has (tick, node, change): a node whose state has a row for which
    ``predicate`` holds (any live node, without one) comes with ``joined`` and
    goes with ``left``.  A node is removed that no later tick finds live.
    """
    changes = transitions(beats.where(F.col("node") != F.lit(self_node)), schedule, conf)
    order = Window.partitionBy("node").orderBy("tick", F.when(F.col("status") == "removed", 1).otherwise(0))
    was = F.coalesce(F.lag("status").over(order), F.lit("unknown"))
    moved = changes.withColumn("was", was).where((F.col("was") == "live") != (F.col("status") == "live"))
    if predicate is not None:
        moved = moved.join(states.where(predicate).select("node").distinct(), "node", "left_semi")
    feed = moved.select("tick", "node", F.when(F.col("status") == "live", "joined").otherwise("left").alias("change"))
    last = changes.groupBy("node").agg(F.max_by("status", F.struct("tick", F.when(F.col("status") == "removed", 1).otherwise(0))).alias("status"))
    return Membership(changes, feed, remove_nodes(states, last.where("status = 'removed'")))
