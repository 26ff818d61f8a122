"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Two fingerprints that differ
in at most k bits differ in at most k bytes, so at least 8 - k positional
bytes are shared: the guaranteed minimum.  With k = 4 that is four of eight.
The index lists every distinct fingerprint under three of its positional bytes
at a time.  Twenty such triples suffice: among any four of the eight positions
one of them is found (see ``position_triples``).  In each list, the shared
positional bytes of a pair are tallied, pairs under the minimum fall out, and
the rest are verified bit by bit.

Work is bounded by distinct fingerprints: copies are collapsed first.  A list
of more than ``block`` fingerprints is split into blocks, and every pair of
blocks is a task of its own, so no task holds more than two blocks whatever
the skew.  A task returns the edges that join its components, at most one for
each fingerprint, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, staged
from .components import connected_components

SEED = 42
#: Lists of up to so many fingerprints are compared by shifted columns.
SHORT = 12
#: Bits of a task's number for each of its two blocks.
BLOCK_BITS = 17


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of a text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Append ``simhash`` (bigint) of every whole text; null counts as empty."""

    def make():
        return lambda texts: [np.array([fingerprint(x.as_py(), width) for x in texts], dtype=np.int64)]

    return annotate(docs, text_col, make, [T.StructField("simhash", T.LongType())], keep)


def position_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the positions 0 to 7, one of them in any four positions.

    The positions fall into three classes of three, three and two.  Taken are
    triples within a class, and those with two positions in a class and one in
    the next: four positions have three in one class, or two in one class and
    one or two in the next, or two there and one in each of the others.
    """
    part = lambda p: p % 3
    out = []
    for t in combinations(range(8), 3):
        classes = sorted(map(part, t))
        if classes[0] == classes[2]:
            out.append(t)
        elif len(set(classes)) == 2:
            twice = classes[1]
            once = classes[0] + classes[1] + classes[2] - 2 * twice
            if once == (twice + 1) % 3:
                out.append(t)
    return out


TRIPLES = position_triples()
#: For each set of equal positions (as bits), the first triple within it.
_FIRST = np.array([next((i for i, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), -1) for m in range(256)], dtype=np.int16)


def _compare(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs pass the count filter and the bit check; equal positions as bits."""
    x = a ^ b
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    y &= np.uint64(0x0101010101010101)
    # The product gathers byte i's flag into bit i of its highest byte.
    differ = (y * np.uint64(0x0102040810204080)) >> np.uint64(56)
    equal = ~differ & np.uint64(0xFF)
    ok = np.bitwise_count(equal) >= 8 - bits
    ok &= np.bitwise_count(x) <= bits
    return ok, equal


def _forest(left: np.ndarray, right: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Edges that join the components of a list (or of two blocks of one)."""
    same = left is right
    both = left if same else np.concatenate([left, right])
    label = np.arange(len(both))
    shift = 0 if same else len(left)
    for i in range(len(left)):
        others = right[i + 1 :] if same else right
        at = i + 1 if same else shift
        ok, _ = _compare(left[i], others, bits)
        hits = np.flatnonzero(ok)
        if not len(hits):
            continue
        roots = np.unique(label[hits + at])
        roots = roots[roots != label[i]]
        if len(roots):
            for r in roots:
                yield int(both[label[i]]), int(both[r])
            low = min(label[i], roots[0])
            label[np.isin(label, roots) | (label == label[i])] = low


def _link_lists(bits: int):
    """Partition function: rows (task, side, fp) sorted by task -> edges."""

    def edges_of(task: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[list, list]:
        us, vs = [], []
        start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        size = np.diff(np.r_[start, len(task)])
        group = np.repeat(np.arange(len(start)), size)
        short = np.repeat(size <= SHORT, size)
        f, g = fp[short], group[short]
        triple = task[short] >> (24 + 2 * BLOCK_BITS)
        for d in range(1, SHORT):
            if len(f) <= d or not (met := g[d:] == g[:-d]).any():
                break
            a, b, t = f[:-d][met], f[d:][met], triple[:-d][met]
            ok, equal = _compare(a, b, bits)
            ok &= _FIRST[equal.astype(np.int64)] == t
            us += a[ok].tolist()
            vs += b[ok].tolist()
        for k in np.flatnonzero(size > SHORT):
            own = slice(start[k], start[k] + size[k])
            x, s = fp[own], side[own]
            left = x[s == 0]
            right = left if s.max() == 0 else x[s == 1]
            for u, v in _forest(left, right, bits):
                us.append(u)
                vs.append(v)
        return us, vs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            rest = [x[cut:] for x in now]
            yield from pack(edges_of(*[x[:cut] for x in now]))
        if rest is not None:
            yield from pack(edges_of(*rest))

    def pack(edges: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if edges[0]:
            a, b = (np.array(x, dtype=np.uint64).view(np.int64) for x in edges)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    return run


def link_fingerprints(prints: DataFrame, bits: int = 4, block: int = 4096) -> DataFrame:
    """Edges (u, v), u > v, between distinct fingerprints, that connect all within ``bits``.

    ``prints`` has distinct, non-null ``simhash``.  Every pair within ``bits``
    bits is connected by a path of returned edges; no edge joins fingerprints
    that such pairs do not connect.
    """
    if not 0 <= bits <= 4:
        raise ValueError("four equal positional bytes are guaranteed for 0 to 4 bits only")
    byte = lambda p: F.shiftrightunsigned("simhash", 8 * p).bitwiseAND(255)
    keys = [F.lit(i << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c) for i, (a, b, c) in enumerate(TRIPLES)]
    postings = prints.select("simhash", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    rows = postings.join(lists, F.col("key") == F.col("k"))
    blocks = F.least(F.ceil(F.col("n") / block), F.lit(1 << BLOCK_BITS)).cast("int")
    own = F.pmod(F.xxhash64("simhash"), blocks).cast("int")
    # A fingerprint of block b meets each block j in the task of (b, j).
    rows = rows.select("simhash", "key", own.alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    low, high = F.least("b", "j").cast("long"), F.greatest("b", "j").cast("long")
    task = F.shiftleft(F.col("key").cast("long"), 2 * BLOCK_BITS) + low * (1 << BLOCK_BITS) + high
    rows = rows.select(task.alias("task"), F.when(F.col("b") == low, 0).otherwise(1).cast("int").alias("side"), "simhash")
    rows = rows.repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(_link_lists(bits), "u long, v long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, block: int = 4096, width: int = 4) -> DataFrame:
    """One row for each document: id, ``simhash``, ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the least id reachable over links of ``bits`` or fewer
    differing bits, the document's own included; null ids count last, and a
    component of null ids alone has a null one.  Texts that are null, empty or
    without a word have fingerprint zero and link like any other.  Repeated
    rows each get their row.  Columns besides id and text are not read.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = staged(with_fingerprints(slim, "text", width, keep=["id"]), "simhash")
    prints = staged(marked.groupBy("simhash").agg(F.min("id").alias("least_id")), "prints")
    stars = connected_components(link_fingerprints(prints, bits, block))
    rooted = prints.join(stars, F.col("simhash") == F.col("u"), "left").select("simhash", "least_id", F.coalesce("v", "simhash").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select(F.col("simhash").alias("print"), "component_id")
    out = marked.join(found, F.col("simhash") == F.col("print"))
    hexed = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return out.select(F.col("id").alias(id_col), "simhash", hexed.alias("fingerprint"), "component_id")
