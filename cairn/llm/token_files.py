"""Token ids as Arrow files of equal-length sequences.

Documents are put in order of id and their ids, each document closed by an end
id, run on across sequences of a fixed length.  A shard is one file in Arrow's
file format: record batches of a fixed number of sequences, with ``input_ids``
(fixed-size list of the narrowest of 16 and 32 unsigned bits that holds the
vocabulary) and ``mask`` (fixed-size list of booleans, false on the padding
after a shard's last id).  Sequence s of a shard is
row s mod B of batch s div B, so a memory-mapped file gives any of them
without copying or reading others.  An index table says where each document
lies.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import WordEncoder, blank_edged, default_vocabulary, plain_byte_level
from .common import bounded, new_path, staged

SEQUENCE, BATCH, END_ID = 2048, 64, 0
#: Bytes of text that a shard takes, about.
SHARD_BYTES = 1 << 26
#: Shards whose sizes are summed together.
SHARD_BLOCK = 1024
#: Words that the library encodes in one call.
GROUP = 1 << 16


class LibraryEncoder:
    """The tokenizers library, shown each distinct word once.

    Where the file is plain byte-level BPE, a text is cut at blanks, where the
    library's own pre-tokenizer always cuts (see ``WordEncoder``).  Texts with
    an added token, and those of any other vocabulary, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.no_padding()
        self.coder.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.highest = max(vocabulary.values())
        self.plain = plain_byte_level(spec)
        self.words = WordEncoder(self.each, self.whole, [t["content"] for t in spec.get("added_tokens", [])])
        # A letter of a vocabulary string stands for a byte.
        self.sizes = np.zeros(self.highest + 1, dtype=np.int64)
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))

    def whole(self, text: str) -> bytes:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def each(self, words: list[str]) -> list[bytes]:
        """Ids of every string by itself.

        Those of a blank and a word that begins and ends in no white space go
        to the library as one text: it cuts before each blank, and the lengths
        of the tokens say where.
        """
        strings = pa.array(words, pa.string())
        fine = pc.match_substring_regex(strings, r"^ ([!-~]|[!-~](?s:.*)[!-~])$").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~fine).tolist():
            fine[i] = words[i][:1] == " " and not blank_edged(words[i][1:])
        length, easy = pc.binary_length(strings).to_numpy(), np.flatnonzero(fine)
        out = list(words)
        for at in range(0, len(easy), GROUP):
            some = easy[at : at + GROUP]
            places = some.tolist()
            text = "".join([words[i] for i in places])
            ids = np.array(self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            reached, wanted = np.cumsum(self.sizes[ids]), np.cumsum(length[some])
            cuts = np.searchsorted(reached, wanted) + 1
            if reached[-1] != wanted[-1] or (reached[cuts - 1] != wanted).any():
                raise ValueError("the library cut a text elsewhere than before a blank")
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            for i, x, y in zip(places, [0, *cuts], cuts):
                out[i] = raw[x:y]
        for i in np.flatnonzero(~fine).tolist():
            out[i] = self.whole(words[i])
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
        if not self.plain:
            return self.whole(text) if text else b""
        return self.words.encode(text)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) in a row, and where each text's end."""
        if self.plain:
            return self.words.encode_array(texts)
        parts = [np.frombuffer(self.encode(x.as_py()), dtype="<u4") for x in texts]
        return np.concatenate([np.zeros(0, dtype="<u4"), *parts]), np.cumsum([len(x) for x in parts], dtype=np.int64)


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def file_schema(length: int, highest: int) -> pa.Schema:
    """``highest``: the highest id that a file may hold."""
    kind = pa.uint16() if highest < 1 << 16 else pa.uint32()
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Ids in, whole batches out; memory holds less than one batch besides the ids given."""

    def __init__(self, uri: str, length: int, rows: int, highest: int):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.length, self.rows, self.schema = length, rows, file_schema(length, highest)
        self.kind = self.schema.field(0).type.value_type.to_pandas_dtype()
        self.sink = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> int:
        """Position of the first id in the shard."""
        at, self.n = self.n, self.n + len(ids)
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        whole = self.length * self.rows
        if self.n_held >= whole:
            flat = np.concatenate(self.held)
            cut = len(flat) - len(flat) % whole
            for i in range(0, cut, whole):
                self._batch(flat[i : i + whole], whole)
            self.held, self.n_held = [flat[cut:].copy()], len(flat) - cut
        return at

    def _batch(self, flat: np.ndarray, used: int) -> None:
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, np.arange(len(flat)) < used)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, dtype=flat.dtype)]), len(flat))
        self.file.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard; a local file is memory-mapped, so sequences are views of it."""

    def __init__(self, uri: str, rows: int = BATCH):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file, self.rows = pa.ipc.open_file(self.source), rows
        self.length = self.file.schema.field("input_ids").type.list_size
        self._last: tuple[int, pa.RecordBatch | None] = (-1, None)

    def batch(self, i: int) -> pa.RecordBatch:
        if self._last[0] != i:
            self._last = (i, self.file.get_batch(i))
        return self._last[1]

    def sequence(self, s: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``s``: views of the file's own buffers."""
        b, r = self.batch(s // self.rows), s % self.rows
        ids, mask = (b.column(c).values.slice(r * self.length, self.length) for c in (0, 1))
        return ids.to_numpy(), mask

    def chunks(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, ``n`` of them, a batch at a time."""
        whole = self.length * self.rows
        while n > 0:
            i, at = divmod(start, whole)
            flat = self.batch(i).column(0).values.to_numpy()[at : at + n]
            yield flat
            start, n = start + len(flat), n - len(flat)


def write_token_files(docs: DataFrame, folder: str, order: list[Column], shards: int, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = SEQUENCE, rows: int = BATCH, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` and write their ids in ``order`` to shards in ``folder``; return the index.

    The index has the id, ``shard``, ``file``, ``shard_start`` and ``n_tokens``
    (the end id included).  Texts are dealt by ranges of ``order`` (a sample of
    which comes to the driver; within it, ties go by text); each shard
    is encoded and written in one function, ``BATCH_BYTES`` of text at a time,
    so ids never leave the worker.  A shard that is written again after a lost
    executor gets a new file name, and only names in the index count.
    """
    path = vocabulary or default_vocabulary()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("shard_start", T.LongType()), T.StructField("n_tokens", T.LongType())])
    dealt = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), _library(path)
        end = np.array([end_id], dtype="<u4")
        uri, writer = f"{folder}/shard-{shard:06d}-{uuid4().hex}.arrow", None
        for whole in batches:
            for batch in bounded(whole, 1):
                writer = writer or ShardWriter(uri, length, rows, max(coder.highest, end_id))
                starts, counts = [], []
                flat, ends = coder.encode_array(batch.column(1))
                for ids in np.split(flat, ends[:-1]):
                    starts.append(writer.add(ids))
                    writer.add(end)
                    counts.append(len(ids) + 1)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shard] * n, pa.int32()), pa.array([uri] * n), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=schema.names)
        if writer:
            writer.close()

    return staged(dealt.select(id_col, text_col).mapInArrow(run, schema), "token-index")


def with_starts(index: DataFrame) -> DataFrame:
    """Append ``start``: ids of all documents before.

    One row for each shard is summed, in blocks of ``SHARD_BLOCK`` shards: a
    window orders the blocks, others the shards of each block.  Spark picks
    the join from the size of the offsets' table.
    """
    sums = index.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.floor(F.col("shard") / SHARD_BLOCK))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("block_offset"))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("shard"))), F.lit(0))
    offsets = sums.withColumn("within", within).join(blocks, F.col("block") == F.col("b"))
    offsets = staged(offsets.select(F.col("shard").alias("s"), (F.col("block_offset") + F.col("within")).alias("shard_offset")), "token-offsets")
    return index.join(offsets, F.col("shard") == F.col("s")).drop("s").withColumn("start", F.col("shard_offset") + F.col("shard_start"))


def read_checksums(index: DataFrame, rows: int = BATCH) -> DataFrame:
    """Append ``ids_crc32`` of every document's ids, read back from the files."""
    names = index.columns
    schema = T.StructType([*index.schema.fields, T.StructField("ids_crc32", T.LongType())])
    where = [names.index(c) for c in ("file", "shard_start", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            sums = []
            for uri, start, n in zip(*(batch.column(i).to_pylist() for i in where)):
                if uri != opened:
                    reader, opened = ShardReader(uri, rows), uri
                crc = 0
                for ids in reader.chunks(start, n):
                    crc = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=schema.names)

    return index.mapInArrow(run, schema)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """(folder, index) of the files of all documents in ascending order of id.

    Null ids come first; rows of one id follow in order of a hash of their
    text, then of the text, so reruns agree and rows of one id can be split
    between shards.  Null and empty texts give the end id alone.  No rows: no
    files.  Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    folder = new_path(spark, "token-files")
    keyed = slim.withColumn("text_hash", F.xxhash64("text"))
    index = write_token_files(keyed, folder, [F.col("id").asc(), F.col("text_hash").asc()], shards, "id", vocabulary=vocabulary)
    return folder, with_starts(index).withColumnRenamed("id", id_col)
