"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of the slots of a prime-sized table; in
turns, every shard claims its next slot that is still free, until none is.
Shards then hold equal numbers of slots (or numbers in proportion to their
weights), and a change of the shard list moves few slots.  Placement is one
hash, one modulus and one lookup in a broadcast table whose size is the
parameter ``slots``, whatever the data hold.

The table depends on parameters alone and is laid out while planning; rows are
placed by DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast, in slots (a few MB).
MOST_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> list[int]:
    """The table: for each slot, the index of the shard that claimed it.

    A shard of weight w claims w slots in each of its turns.
    """
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and one at least")
    weights = [1] * len(shards) if weights is None else list(weights)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    at = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i, w in enumerate(weights):
            for _ in range(min(w, free)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                table[at[i]], free = i, free - 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: 60 bits of the md5 of its text (null as empty), modulo ``slots``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int, weights: Sequence[int] | None = None) -> DataFrame:
    """The table as rows (slot int, shard string)."""
    claims = ",".join(map(str, fill(shards, slots, weights)))
    names = F.array(*[F.lit(s) for s in shards])
    table = spark.range(1).select(F.posexplode(F.split(F.lit(claims), ",")).alias("slot", "claim"))
    return table.select("slot", F.element_at(names, F.col("claim").cast("int") + 1).alias("shard"))


def assign_shards(
    df: DataFrame,
    key: str = "doc_id",
    shards: Sequence[str] = tuple(f"shard-{i:02d}" for i in range(16)),
    slots: int = 2039,
    weights: Sequence[int] | None = None,
) -> DataFrame:
    """All rows and columns of ``df`` with ``slot`` and ``shard`` appended.

    Equal keys share a shard; a null key counts as the empty text.  Columns of
    those names are replaced.  Rows never move: no shuffle, whatever the skew.
    """
    taken = {c.lower() for c in df.columns}
    at = next(name for i in range(len(taken) + 1) if (name := f"_slot{i}") not in taken)
    table = lookup_table(df.sparkSession, shards, slots, weights).withColumnRenamed("slot", at)
    keyed = df.withColumn(at, slot_of(F.col(f"`{key}`"), slots)).drop("slot", "shard")
    placed = keyed.join(F.broadcast(table), at)
    return placed.select(*[F.col(f"`{c}`") for c in keyed.columns if c != at], F.col(at).alias("slot"), "shard")
