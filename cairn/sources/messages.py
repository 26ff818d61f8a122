"""Delta messages as JSON lines, one row of a replica each; lines that cannot be read are set apart, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "node string, key string, value string, version long"


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of a frame or stream with ``value``: a message needs a node, a key and a version."""
    read = lines.select(F.col("value").cast("string").alias("line")).withColumn("m", F.from_json("line", FIELDS))
    fine = F.col("m.node").isNotNull() & F.col("m.key").isNotNull() & F.col("m.version").isNotNull()
    return read.where(fine).select("m.*"), read.where(~F.coalesce(fine, F.lit(False))).select("line")


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The text files of a folder, or the stream of those that come to it."""
    return (spark.readStream if streaming else spark.read).text(path)


def write(rows: DataFrame, path: str) -> None:
    """Append rows as messages."""
    rows.select(F.to_json(F.struct("node", "key", "value", "version")).alias("value")).write.mode("append").text(path)
