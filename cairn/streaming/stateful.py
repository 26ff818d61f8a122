"""Stateful streams: last writer wins, rolling means, and the gossip loop."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import replica
from ..operators.liveness import LivenessConfig, Node


def lww(rows: DataFrame) -> DataFrame:
    """The highest version of each (node, key) of a stream: an aggregation that keeps one row a key (update or complete mode)."""
    best = rows.groupBy("node", "key").agg(F.max(F.struct("version", "value")).alias("b"))
    return best.select("node", "key", F.col("b.value").alias("value"), F.col("b.version").alias("version"))


def rolling_mean(beats: DataFrame, conf: LivenessConfig, idle: str | None = None) -> DataFrame:
    """(node, t, sample, mean) for every beat after a node's first: a window of samples is each node's state.

    A node's beats of one micro-batch are put in order; one not later than
    what the state has seen is dropped.  With ``idle`` (an interval, as "1
    hour"; the stream then needs a watermark on ``ts``), a node silent for so
    long loses its state.
    """
    name = next(f.simpleString().split(":")[1] for f in beats.schema if f.name == "node")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        node = Node(conf)
        if state.exists:
            node.last, held = state.get
            node.samples, node.total = deque(held), sum(held)
        out = []
        for t in sorted(t for f in frames for t in f["t"].tolist() if t == t):
            if node.last is not None and t <= node.last:
                continue
            sample = node.beat(t)
            if sample is not None:
                out.append((key[0], t, sample, node.mean))
        state.update((node.last, list(node.samples)))
        if idle:
            state.setTimeoutDuration(wait)
        if out:
            yield pd.DataFrame(out, columns=["node", "t", "sample", "mean"])

    return beats.groupBy("node").applyInPandasWithState(step, f"node {name}, t double, sample double, mean double", "last double, samples array<double>", "append", timeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read back what it wrote to ``path``.

    In complete mode the last micro-batch is the result: each has a folder of
    its own, named by its number, so a batch that is run again overwrites itself.
    """
    spark, schema = stream.sparkSession, stream.schema
    last: list[int] = []
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    writer.foreachBatch(keep).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], schema)
    where = [f"{path}/batch={last[0]}"] if mode == "complete" else [f"{path}/batch=*"]
    return spark.read.schema(schema).parquet(*where)


class GossipLoop:
    """Messages in micro-batches: each batch of deltas is applied to the state, which is a table of its own.

    ``on_round`` gets the state after each batch (to evaluate liveness, say).
    A batch that is run again starts from the state before it.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame, on_round: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.on_round = spark, path.rstrip("/"), on_round
        initial.select(*replica.COLUMNS).write.mode("overwrite").parquet(f"{self.path}/state=start")
        self.at: dict[int, str] = {-1: f"{self.path}/state=start"}

    def state(self) -> DataFrame:
        return self.spark.read.parquet(self.at[max(self.at)])

    def step(self, rows: DataFrame, number: int) -> None:
        before = self.spark.read.parquet(self.at[max(n for n in self.at if n < number)])
        after = replica.apply_delta(before, rows.groupBy("node", "key").agg(F.max(F.struct("version", "value")).alias("b")).select("node", "key", "b.value", "b.version"))
        after.write.mode("overwrite").parquet(f"{self.path}/state={number}")
        self.at[number] = f"{self.path}/state={number}"
        if self.on_round:
            self.on_round(self.state(), number)

    def start(self, deltas: DataFrame, checkpoint: str, interval: float | None = None) -> StreamingQuery:
        """The running loop: a round every ``interval`` seconds, or over what there is now; ``stop()`` ends it."""
        writer = deltas.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.step)
        return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{interval} seconds")).start()

    def run(self, deltas: DataFrame, checkpoint: str) -> DataFrame:
        """Apply what the stream of (node, key, value, version) holds now; the state after it."""
        self.start(deltas, checkpoint).awaitTermination()
        return self.state()
