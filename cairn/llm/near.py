"""Near copies by SimHash: a byte-position inverted index, then exact similarity.

``simhash``'s 64 bits cannot cover a Jaccard similarity of 0.8: there 15 % of
the bits differ, and eight positional bytes guarantee a shared one only under
12.5 %.  The fingerprint is therefore wider, ``LISTS`` units of two positional
bytes, over the distinct shingles of five words, and what is kept is a chance
and no certainty: at 0.8 a unit is shared with probability 0.073, so a pair
meets in some list of 128 with probability 0.9999, in nine on average.

The index lists every distinct text under each of its units.  A posting carries
the ``SPAN`` units that follow its own, around the end.  In each list the
shared positional bytes of a pair are tallied, pairs under ``LEAST_BYTES`` more
than the list's own two fall out, and so do those that differ in more than
``MOST_BITS`` of the carried bits.  What is left is joined, and within what it
joins every pair is compared by its whole shingle sets.

A group of n near copies meets in many lists, which would join its texts up to
128 n times.  So the ``FIRST`` twelve lists are met first, and the others join
only what those left apart.  Beyond twelve lists taken by chance another joins
a thirteenth of the texts at most, on average: some 21 edges for each text at
most, and more only where lists are of several blocks.

Work is bounded by distinct texts.  Long lists, and what lists join, are split
into blocks as in ``simhash``: a task returns a forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, staged
from .components import connected_components

WIDTH, SEED = 5, 42
#: Similarity from which two texts are near copies, as a fraction.
LEAST = (4, 5)
#: Units of a fingerprint, each two positional bytes and one list of the index.
LISTS = 128
#: Lists that are met before the others, about the root of their number.
FIRST = range(0, LISTS, 11)
#: Units that a posting carries: 16 positional bytes, 128 bits.
SPAN = 8
#: Carried bytes that a pair shares at least, and bits in which it may differ.
LEAST_BYTES, MOST_BITS = 1, 28
#: Shingles whose bits are added at a time: their counts fit a byte.
CHUNK = 255
#: Texts whose postings are made at a time.
TEXTS = 1000
#: Bits of a task's number for each of its two blocks.
BLOCK_BITS = 17
#: One text in so many is counted to find long lists.
COUNTED = 16
_SALTS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, LISTS // 4, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))), dtype=np.uint64))


def widened(h: np.ndarray) -> np.ndarray:
    """The bits of each shingle, ``2 * LISTS`` bytes, drawn from its hash."""
    x = h[:, None] ^ _SALTS
    for times in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x *= np.uint64(times)
        x ^= x >> np.uint64(33)
    return x.astype("<u8", copy=False).view(np.uint8)


def fingerprint(h: np.ndarray) -> bytes:
    """SimHash of a shingle set: a bit is 1 if set in over half the shingles; zero without any."""
    ones = np.zeros(16 * LISTS, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.add.reduce(np.unpackbits(widened(h[at : at + CHUNK]), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def text_key(text: str) -> Column:
    """64 bits that stand for a text: exact copies have the same."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def postings(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n fingerprints as rows of bytes: list numbers and both carried words, each n by ``LISTS``."""
    units = np.ascontiguousarray(prints).view("<u2").astype(np.uint64)
    lists = (np.arange(LISTS) << 16) + units.astype(np.int64)
    turned = np.concatenate([units, units[:, : SPAN + 1]], axis=1)
    four = sum(turned[:, i : turned.shape[1] - 3 + i] << np.uint64(16 * i) for i in range(4))
    return lists, four[:, 1 : LISTS + 1], four[:, 1 + SPAN // 2 : LISTS + 1 + SPAN // 2]


def _post(chosen: Iterable[int]):
    """Partition function: rows (key, root, print) -> rows (list, key, root, one, two) of the chosen lists."""
    chosen = list(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, 2 * LISTS)
                lists, one, two = (x[:, chosen].ravel().view(np.int64) for x in postings(prints))
                key, root = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), len(chosen)) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*map(pa.array, (lists, key, root, one, two))], names=["list", "key", "root", "one", "two"])

    return run


def _differing_bytes(x: np.ndarray) -> np.ndarray:
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return np.bitwise_count(y & np.uint64(0x0101010101010101))


def meeting(task: np.ndarray, root: np.ndarray, side: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that join what passes the count filter and the bit check in each task.

    Rows are sorted by ``task`` and ``root``; equal roots of a task are joined
    already, and the first of them stands for all.  Where a task has two sides,
    only pairs of both are compared.
    """
    new = np.r_[True, task[1:] != task[:-1]]
    start = np.flatnonzero(new)
    own = np.maximum.accumulate(np.where(new | np.r_[True, root[1:] != root[:-1]], np.arange(len(task)), 0))
    label = own
    size = np.diff(np.r_[start, len(task)])
    mixed = np.repeat(np.maximum.reduceat(side, start) > 0, size)
    # A task of one root has nothing to join.
    size = np.repeat(np.where(np.maximum.reduceat(own, start) > start, size, 0), size)
    us, vs = [], []
    # Tasks of like size go together, so that few shifted rows leave their task.
    low = 1
    while low < size.max():
        rows = np.flatnonzero((size > low) & (size <= 2 * low))
        low *= 2
        t = task[rows]
        for d in range(1, low):
            met = np.flatnonzero(t[d:] == t[:-d])
            if not len(met):
                break
            i, j = rows[met], rows[met + d]
            new = (label[i] != label[j]) & ((side[i] != side[j]) | ~mixed[i])
            i, j = i[new], j[new]
            x, y = one[i] ^ one[j], two[i] ^ two[j]
            ok = _differing_bytes(x) + _differing_bytes(y) <= 2 * SPAN - LEAST_BYTES
            ok &= np.bitwise_count(x) + np.bitwise_count(y) <= MOST_BITS
            if not ok.any():
                continue
            i, j = i[ok], j[ok]
            us.append(own[i])
            vs.append(own[j])
            # Equal labels are joined by pairs already given; the reverse need not hold.
            parent = np.arange(len(task))
            parent[np.maximum(label[i], label[j])] = np.minimum(label[i], label[j])
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            label = parent[label]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def stars(i: np.ndarray, j: np.ndarray, side: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (u, v), u > v, that join what the pairs of places join.

    In a component the keys of a side go to the least of them, and the greater
    of the two least to the other.  So what a block returns is mostly the same
    from task to task, where the pairs as met would differ.
    """
    at, pairs = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = pairs[: len(i)], pairs[len(i) :]
    label = np.arange(len(at))
    while (label[i] != label[j]).any():
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    side, key = side[at], key[at]
    order = np.lexsort((key, side, label))
    label, side, key = label[order], side[order], key[order]
    start = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (side[1:] != side[:-1])][: len(at)])
    least = key[start]
    v = np.repeat(least, np.diff(np.r_[start, len(at)]))
    both = np.flatnonzero(label[start[1:]] == label[start[:-1]])
    a, b = least[both], least[both + 1]
    u, v = np.concatenate([key[key != v], np.maximum(a, b)]), np.concatenate([v[key != v], np.minimum(a, b)])
    return u, v


def _edges(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (task, root, side, one, two) sorted by task and root -> edges between roots."""

    def edges(task, root, side, one, two):
        yield from _edges(*stars(*meeting(task, root, side, one.view(np.uint64), two.view(np.uint64)), side, root))

    rest = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[cut:] for x in now]
        if cut:
            yield from edges(*[x[:cut] for x in now])
    if rest is not None:
        yield from edges(*rest)


def link_prints(prints: DataFrame, block: int = 4096) -> DataFrame:
    """Edges (u, v), u > v, that join the texts whose fingerprints meet in a list and pass its checks.

    ``prints`` has distinct ``key`` and ``print``.  A list of more than
    ``block`` texts, by a count of one text in ``COUNTED``, is split into
    blocks, and every pair of blocks is a task.  What the ``FIRST`` lists join
    has one root in the others, which return edges between roots.
    """
    schema = "list long, key long, root long, one long, two long"
    rooted = prints.select("key", F.col("key").alias("root"), "print")
    some = rooted.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0).mapInArrow(_post(range(LISTS)), schema)
    long = staged(some.groupBy(F.col("list").alias("l")).agg((F.count("*") * COUNTED).alias("n")).where(F.col("n") > block), "long-lists")

    def met(rooted: DataFrame, lists: Iterable[int]) -> DataFrame:
        blocks = F.least(F.ceil(F.coalesce("n", F.lit(1)) / block), F.lit(1 << BLOCK_BITS)).cast("int")
        rows = rooted.mapInArrow(_post(lists), schema).join(long, F.col("list") == F.col("l"), "left")
        # A text of block b meets each block j in the task of (b, j).
        rows = rows.select("list", "root", "one", "two", F.pmod(F.xxhash64("key", F.lit(SEED)), blocks).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
        low, high = F.least("b", "j").cast("long"), F.greatest("b", "j").cast("long")
        task = F.shiftleft("list", 2 * BLOCK_BITS) + low * (1 << BLOCK_BITS) + high
        rows = rows.select(task.alias("task"), "root", F.when(F.col("b") == low, 0).otherwise(1).cast("byte").alias("side"), "one", "two")
        return rows.repartition("task").sortWithinPartitions("task", "root", "side").mapInArrow(_link, "u long, v long").distinct()

    first = connected_components(met(rooted, FIRST))
    rooted = prints.join(first, F.col("key") == F.col("u"), "left").select("key", F.coalesce("v", "key").alias("root"), "print")
    return first.unionByName(met(rooted, [i for i in range(LISTS) if i not in FIRST]))


def forest(sets: list[np.ndarray], split: int) -> Iterator[tuple[int, int]]:
    """Pairs that join the components of the sets at ``LEAST``.

    ``split`` is 0 to compare all with all, or the number of sets to compare
    with the others.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.r_[0, np.cumsum(size)]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    held = np.bincount(code)
    first = np.r_[0, np.cumsum(held)]
    label = np.arange(n)
    for i in range(split or n):
        if (label == label[0]).all():
            return
        mine = code[start[i] : start[i + 1]]
        runs = held[mine]
        at = np.repeat(first[mine] - np.r_[0, np.cumsum(runs)][:-1], runs) + np.arange(runs.sum())
        shared = np.bincount(owner[at], minlength=n)
        # shared / union >= a / b, in whole numbers.
        a, b = LEAST
        near = shared * (a + b) >= a * (size + size[i])
        near[: split or i + 1] = False
        roots = np.unique(label[near])
        roots = roots[roots != label[i]]
        if len(roots):
            for r in roots:
                yield int(label[i]), int(r)
            label[np.isin(label, roots) | (label == label[i])] = min(label[i], roots[0])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, low, high, side, key, text) sorted by task and side -> edges."""

    def rows():
        for batch in batches:
            *numbers, keys = [c.to_pylist() for c in batch.columns[:5]]
            for *task, side, key, text in zip(*numbers, keys, batch.column(5)):
                yield tuple(task), side, key, shingles(text.as_py())

    for _, group in groupby(rows(), key=lambda r: r[0]):
        _, sides, keys, sets = zip(*group)
        task_split = sides.count(0) if any(sides) else 0
        if len(keys) < 2 or task_split == 0 and any(sides):
            continue
        pairs = np.array(list(forest(list(sets), task_split)), dtype=np.int64).reshape(-1, 2)
        yield from _edges(*stars(pairs[:, 0], pairs[:, 1], np.array(sides), np.array(keys, dtype=np.int64)))


def near_components(docs: DataFrame, text_col: str = "text", block: int = 1024) -> DataFrame:
    """(key, root) of every distinct text that has a near copy: ``text_key`` and its component's least.

    Two texts are linked at a similarity of ``LEAST`` or more; texts that are
    null, empty or without a word are copies of each other.  Other columns are
    not read.
    """
    texts = docs.select(text_key(f"`{text_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def make():
        return lambda batch: [[fingerprint(shingles(x.as_py())) for x in batch]]

    marked = annotate(texts, "text", make, [T.StructField("print", T.BinaryType())], keep=["key"])
    prints = staged(marked.groupBy("key").agg(F.first("print").alias("print")), "prints")
    joined = connected_components(link_prints(prints, 4 * block))
    clusters = staged(joined.select(F.col("u").alias("k"), F.col("v").alias("cluster")).unionByName(joined.select(F.col("v").alias("k"), F.col("v").alias("cluster")).distinct()), "clusters")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).withColumnRenamed("cluster", "c")
    placed = clusters.join(blocks, F.col("cluster") == F.col("c")).select("k", "cluster", "blocks", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("own"))
    distinct = texts.groupBy("key").agg(F.first("text").alias("text"))
    rows = distinct.join(placed, F.col("key") == F.col("k"))
    # A text of one block meets each block j in the task of both.
    rows = rows.select("cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "key", "text")
    low, high = F.least("own", "j"), F.greatest("own", "j")
    rows = rows.select("cluster", low.alias("low"), high.alias("high"), F.when(F.col("own") == low, 0).otherwise(1).alias("side"), "key", "text")
    rows = rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "side")
    found = connected_components(rows.mapInArrow(_verify, "u long, v long"))
    return found.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
