"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash.  A source that must give T of its S words
gives each document floor(T / S) times whole, and those whose hash lies below
a threshold once more.  The threshold comes from histograms, never from a sort
of documents: words are summed by source and by the top 12 bits of the hash,
running sums find the bucket in which the budget runs out, and only the rows
of that bucket are summed again by the next 12 bits.  Copies of a budget are
nested: a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, word_count

BITS, LEVEL_BITS = 60, 12
#: Thresholds are broadcast up to so many sources; beyond it Spark picks the join.
BROADCAST_SOURCES = 100_000


def mix_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of id and text, null as empty: reruns agree."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): shares of the total, capped, the excess reshared by weight.

    Sources by code point, null last, weigh ``weights`` in turn.  In order of
    size per weight the sources at their cap are a prefix, so one pass of
    running sums shares the excess.  One row for each source: the windows over
    all of them are small.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), turn))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)  # as many rows as sources
    w = w.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weight_left"),
        F.row_number().over(order).alias("place"),
    )
    level = (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left")
    fits = level * F.col("weight") <= (F.col("source_size") * most).cast("double")
    w = w.withColumn("first_fit", F.min(F.when(fits, F.col("place"))).over(Window.partitionBy()))
    w = w.withColumn("level", F.max(F.when(F.col("place") == F.col("first_fit"), level)).over(Window.partitionBy()))
    under = F.col("place") >= F.col("first_fit")
    return w.select(
        "source", "source_size",
        F.when(under, F.col("level") * F.col("weight")).otherwise((F.col("source_size") * most).cast("double")).alias("target"),
    )


def _thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, cut): documents with a hash below ``cut`` count once more."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("copies", full)
    state = targets.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.select("source", "source_size", "target", "copies", F.lit(0).cast("long").alias("low"), "left", F.lit(None).cast("long").alias("cut"))
    many = targets.count() > BROADCAST_SOURCES
    for shift in range(BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_ = state.where("cut is null")
        rows = docs.join(open_.select(F.col("source").alias("s"), "low") if many else F.broadcast(open_.select(F.col("source").alias("s"), "low")), F.col("source").eqNullSafe(F.col("s")))
        width = 1 << (shift + LEVEL_BITS)
        rows = rows.where((F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + width))
        bucket = F.shiftright(F.col("hash"), shift)
        sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        sums = sums.select(F.col("source").alias("s"), "bucket", "words", "least", "most", "upto")
        small = open_.select("source", "left")
        met = sums.join(small if many else F.broadcast(small), F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("left"))
        first = met.groupBy("source").agg(F.min_by(F.struct("bucket", "words", "least", "most", "upto"), "bucket").alias("b"))
        first = first.select(F.col("source").alias("s"), F.col("b.*"))
        gone = F.col("left") - (F.col("upto") - F.col("words"))
        alone = (F.col("least") == F.col("most")) | F.lit(shift == 0)
        # One hash is left in the bucket: it is in if that brings the sum nearer.
        nearer = F.when(2 * gone > F.col("words"), F.col("least") + 1).otherwise(F.col("least"))
        state = state.join(first if many else F.broadcast(first), F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "copies",
            F.when(F.col("bucket").isNull(), F.col("low")).otherwise(F.shiftleft(F.col("bucket"), shift)).alias("low"),
            F.when(F.col("bucket").isNull(), F.col("left")).otherwise(gone).alias("left"),
            F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("bucket").isNull(), F.lit(1 << BITS)).when(alone, nearer).alias("cut"),
        )
        state = staged(state, "mix-state")
        if state.where("cut is null").isEmpty():
            break
    return state


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row for each document: how many of its words the mix takes.

    Returns the id, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` (0 to ``most``) and ``taken`` = copies * size.  Null and empty
    texts have size 0; null is a source of its own; rows that agree in id and
    text have one hash and stand or fall together; a source's sum misses its
    target by half of the words of one hash at most: of its boundary document,
    with all its repeated rows.  With ``keep``, these columns of the row come
    before ``copies`` instead; no join on the id is needed.  Other columns are
    not read.
    """
    hashed = mix_hash(f"`{id_col}`", f"`{text_col}`").alias("hash")
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), hashed)
    slim = staged(slim, "mix-sizes")
    targets = staged(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    cuts = _thresholds(slim, targets).select(F.col("source").alias("s"), "source_size", "target", "copies", "cut")
    if targets.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    copies = F.least(F.col("copies") + (F.col("hash") < F.col("cut")).cast("long"), F.lit(most).cast("long"))
    if keep is not None:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{source_col}`").alias("source"), hashed)
        return rows.join(cuts, F.col("source").eqNullSafe(F.col("s"))).select("row.*", copies.alias("copies"))
    out = slim.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), "hash").select(
        id_col, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.col("hash").alias("mix_hash")
    )
