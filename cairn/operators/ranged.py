"""Neighbours in a long order, found in pieces.

A window over one key puts all rows of the key in one task.  Here a key's order
(whole numbers) is cut into ranges: each is a window of its own, and the first
or last row of a range meets its neighbour in a window over ranges, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of the order in one range.
RANGE = 1 << 16


def _met(rows: DataFrame, by: list[str], order: str, value: Column, name: str, before: bool, span: int) -> DataFrame:
    cut = rows.withColumn("_range", F.floor(F.col(order) / span)).withColumn("_value", F.struct(value.alias("x")))
    own = Window.partitionBy(*by, "_range").orderBy(order)
    pick, shift = (F.max_by, F.lag) if before else (F.min_by, F.lead)
    edges = cut.groupBy(*by, "_range").agg(pick("_value", order).alias("_edge"))
    edges = edges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), shift("_edge").over(Window.partitionBy(*by).orderBy("_range")).alias("_far"))
    same = F.col("_range").eqNullSafe(F.col("_of"))
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = cut.withColumn("_near", shift("_value").over(own)).join(edges, same)
    return found.select(*rows.columns, F.coalesce("_near", "_far")["x"].alias(name))


def with_previous(rows: DataFrame, by: list[str], order: str, value: Column, name: str, span: int = RANGE) -> DataFrame:
    """Append ``name``: ``value`` of the row before in ``order`` among rows that agree in ``by``; null for the first."""
    return _met(rows, by, order, value, name, True, span)


def with_next(rows: DataFrame, by: list[str], order: str, value: Column, name: str, span: int = RANGE) -> DataFrame:
    """Append ``name``: ``value`` of the row after; null for the last."""
    return _met(rows, by, order, value, name, False, span)
