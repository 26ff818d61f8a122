"""What the operators share: words, shared scratch tables, and text annotation."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..folders import delete, new_path  # noqa: F401  (operators take new_path from here)
from ..folders import written as staged

#: A word is a run of anything but these six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text, about, whose results a task holds at a time.
BATCH_BYTES = 1 << 22


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id falls in fold -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``staged`` table that nothing will read again."""
    for name in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def bounded(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in ``column`` hold ``most`` bytes or are one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def annotate(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[pa.Array], list]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append columns computed from each whole text, in Arrow batches.

    ``make`` runs once a task and returns a function from an array of texts
    (null as null) to one array for each of ``fields``.  ``keep`` names the
    columns that stay (all by default).  A kept column with the name of a new
    one is replaced, as by ``withColumn``.  What a batch returns is made and
    passed on in slices of ``BATCH_BYTES`` of text.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_annotated_text"))
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for whole in batches:
            for batch in bounded(whole, whole.num_columns - 1):
                out = judge(batch.column(batch.num_columns - 1))
                columns = [batch.column(i) for i in range(len(kept))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(len(kept) + i).type) for i, x in enumerate(out)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return source.mapInArrow(run, schema)
