"""Versioned key-value data over a command log.

A log has (version, txn_id, ord, op, key, value): op is get, set or del, and a
null value deletes.  State is derived: the last write of a key wins, and a
tombstone hides the key.  An empty value is a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranged


def latest(rows: DataFrame, order: str | list[str] = "version") -> DataFrame:
    """(key, value, version) by the last row of each key, tombstones included.

    One aggregation with a map-side part: hot keys shrink before the shuffle.
    """
    by = [order] if isinstance(order, str) else order
    last = F.max(F.struct(*by, F.col("value").alias("_value"), F.col("version").alias("_version"))).alias("last")
    return rows.groupBy("key").agg(last).select("key", F.col("last._value").alias("value"), F.col("last._version").alias("version"))


def writes(log: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Rows that touch state; with ``committed`` (txn_id), of those transactions alone."""
    rows = log.where("op <> 'get'")
    return rows if committed is None else rows.join(committed.select("txn_id").distinct(), "txn_id", "left_semi")


def state(log: DataFrame, as_of: Column | int | None = None) -> DataFrame:
    """Live (key, value, version), of the snapshot after transaction ``as_of`` if given."""
    rows = writes(log)
    if as_of is not None:
        rows = rows.where(F.col("txn_id") <= as_of)
    return latest(rows).where("value is not null")


def get_multi(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of (ord, key) requests: order kept as ``ord``, repeats kept, missing keys null."""
    return keys.join(current.select("key", "value"), "key", "left").select("ord", "key", "value")


def apply_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """State after one atomic batch (ord, key, value): in order, null deletes, the last of a key wins."""
    base = current.select("key", "value", F.lit(-1).cast("long").alias("ord"), F.lit(0).cast("long").alias("version"))
    new = batch.select("key", "value", F.col("ord").cast("long"), F.lit(1).cast("long").alias("version"))
    return latest(base.unionByName(new), "ord").where("value is not null").select("key", "value")


def delete_keys(current: DataFrame, keys: DataFrame) -> DataFrame:
    """State without ``keys``; absent ones are no matter."""
    return current.join(keys.select("key"), "key", "left_anti").select("key", "value")


def metrics(current: DataFrame, log: DataFrame) -> DataFrame:
    """One row: live keys, bytes of their values, and commands (distinct transaction and call)."""
    sizes = current.agg(F.count("*").alias("keys_count"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("values_size_in_bytes"))
    call = F.struct("txn_id", F.when(F.col("op") == "get", "get").otherwise("set"))
    return sizes.crossJoin(log.agg(F.countDistinct(call).alias("cmds_count")))  # one row each


def with_previous(log: DataFrame) -> DataFrame:
    """Writes with ``prev``: the value of the key before, null if it had none."""
    return ranged.with_previous(writes(log), ["key"], "version", F.col("value"), "prev")


def keys_count_steps(log: DataFrame) -> DataFrame:
    """One row: the sum of +1 for a new key and -1 for a deleted one."""
    step = F.when(F.col("value").isNotNull() & F.col("prev").isNull(), 1).when(F.col("value").isNull() & F.col("prev").isNotNull(), -1).otherwise(0)
    return with_previous(log).agg(F.coalesce(F.sum(step), F.lit(0)).cast("long").alias("keys_count"))


def values_size_literal(log: DataFrame) -> DataFrame:
    """The gauge as the reference counts it: an overwrite takes the old size off and adds none."""
    step = F.when(F.col("prev").isNotNull(), -F.octet_length("prev")).when(F.col("value").isNotNull(), F.octet_length("value")).otherwise(0)
    return with_previous(log).agg(F.coalesce(F.sum(step), F.lit(0)).cast("long").alias("values_size"))


def parse_pairs(raw: DataFrame) -> DataFrame:
    """``k=v`` to key and value: what follows a second ``=`` is lost, no ``=`` gives a null value."""
    parts = F.split("raw", "=")
    return raw.select("raw", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"))


def require_pairs(raw: DataFrame) -> DataFrame:
    """``parse_pairs``, where a row without ``=`` fails the query with the text at fault."""
    bad = F.raise_error(F.concat(F.lit("no '=' in pair: "), F.col("raw"))).cast("string")
    return parse_pairs(raw).select("raw", "key", F.when(F.col("value").isNull() & F.col("raw").isNotNull(), bad).otherwise(F.col("value")).alias("value"))


def parse_pair(text: str) -> tuple[str, str]:
    """One ``k=v`` as ``parse_pairs`` reads it."""
    key, *rest = text.split("=")
    if not rest:
        raise ValueError(f"no '=' in pair: {text}")
    return key, rest[0]


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that differ: (key, before, after, change)."""
    b, a = before.select("key", F.col("value").alias("before")), after.select("key", F.col("value").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return b.join(a, "key", "full").where(~F.col("before").eqNullSafe(F.col("after"))).withColumn("change", change)


def version_history(log: DataFrame) -> DataFrame:
    """Every written value with the versions it holds for: [valid_from, valid_to), open if null."""
    rows = ranged.with_next(writes(log), ["key"], "version", F.col("version"), "valid_to")
    return rows.where("value is not null").select("key", "value", F.col("version").alias("valid_from"), "valid_to")
