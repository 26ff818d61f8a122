"""Approximate nearest neighbours by inner product: an adaptive dimension scan.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest length
(queries: 0), so the largest inner product is the least distance.  They are
dealt to inverted lists around centroids fitted on a bounded sample; every
vector is indexed.  All are rotated at random and read in blocks of columns.

How many lists a query probes is its own: each list's mean and spread of
distances give the number of its vectors expected among the k nearest, and
lists are taken, the densest in them first, until all but ``MISSED`` of these
are covered.  The first few lists are scanned in a pass of their own; the k-th
best distance found there goes with the query to all its other lists.

Within a list, a candidate is abandoned when its partial distance says that the
whole is over the limit (the k-th best so far): after d of D columns of a
random rotation, a vector at the limit has shown a share of it that follows
Beta(d / 2, (D - d) / 2), and more than that law's quantile at 1 - ALPHA rejects
the hypothesis.  A list whose ball lies beyond the limit is not read at all.
Survivors get their inner product from the original vectors.

Copies are searched once: a distinct vector carries its k + 1 least ids, which
are all that any answer can use.  Lists are packed into bins (or cut into blocks
where they are long) and their queries into chunks, so a task's memory is
bounded whatever the skew.  Work is the number of queries times the vectors in
the lists they probe; where queries are a share of the rows and vectors have no
structure, it grows with the square of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

SEED, COLUMNS = 7, 16
#: Chance that a test abandons a vector that lies at the limit, and the share of expected hits that unprobed lists may hold.
ALPHA, MISSED = 0.02, 0.06
#: The centroids' sample, in vectors, and the most lists (longer lists beyond it).
SAMPLE, MOST_LISTS = 20_000, 4096
#: Vectors, and queries of them, in one task.
POINTS, QUERIES = 4096, 1024
#: Vectors in the lists of a query's first pass, about: 2 k at least, then so large a share of all up to so many.
FIRST_SHARE, FIRST = 1 / 32, 1024
#: Share of pairs left from which a list is read pair by pair and no more as one product.
SPARSE = 0.75
#: Queries whose lists are chosen at a time, and pairs read at a time.
AT_A_TIME, PAIRS = 256, 1 << 16


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) as doubles: without null ids, null or zero vectors, and null or non-finite components."""
    x = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return x.where(F.col("id").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda c: c != 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(h1, h2, ids, vec): every distinct vector once, with its ``most`` least ids.

    Ids are gathered under salts, 4096 and 64 parts for each vector before
    one, so a vector that many rows share is met in pieces.
    """
    keys = rows.select(F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2"), F.col("id"), F.pmod(F.xxhash64("id"), F.lit(4096)).alias("salt"))
    least = lambda ids: F.slice(F.array_sort(F.array_distinct(ids)), 1, most)
    part = keys.groupBy("h1", "h2", "salt").agg(least(F.collect_set("id")).alias("ids"))
    for salt in (F.col("salt") % 64, F.lit(0)):
        part = part.groupBy("h1", "h2", salt.alias("salt")).agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    firsts = part.select("h1", "h2", "ids", F.col("ids")[0].alias("first"))
    met = rows.join(firsts, (F.col("id") == F.col("first")) & (F.xxhash64("vec") == F.col("h1")) & (F.xxhash64(F.lit(SEED), "vec") == F.col("h2")))
    return met.groupBy("h1", "h2").agg(F.first("ids").alias("ids"), F.first("vec").alias("vec"))


def with_representatives(points: DataFrame) -> DataFrame:
    """Append ``rep``: of vectors that share their least id, one is true.  Different representatives have different ids."""
    first = F.col("ids")[0]
    twice = points.groupBy(first.alias("first")).agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("least")).where("n > 1")
    twice = staged(twice.select("first", "least"), "repeated")
    rep = F.col("least").isNull() | (F.struct("h1", "h2") == F.col("least"))
    return points.join(twice, first == F.col("first"), "left").select("h1", "h2", "ids", "vec", rep.alias("rep"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def beta_quantile(a: float, b: float, p: float) -> float:
    """Quantile of the Beta law by a sum over a grid."""
    x = (np.arange(20_000) + 0.5) / 20_000
    log_density = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    mass = np.cumsum(np.exp(log_density - log_density.max()))
    return float(x[np.searchsorted(mass, p * mass[-1])])


def below(z: np.ndarray) -> np.ndarray:
    """The normal law's distribution function, by a rational approximation with seven digits."""
    u = np.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * u)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-u * u) / 2
    return np.where(z < 0, tail, 1 - tail)


class Lists:
    """Rotation, centroids and the greatest length; after ``measured``, what lists hold."""

    def __init__(self, sample: np.ndarray, longest: float, n: int, rounds: int = 10):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1] + 1
        self.longest = longest
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.turned(sample)
        k = max(1, min(MOST_LISTS, int(n**0.5), len(x)))
        self.centroids = x[np.sort(rng.choice(len(x), k, replace=False))]
        for _ in range(rounds):
            near = self.nearest(x)[0]
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, near, x)
            n_in = np.bincount(near, minlength=k)
            self.centroids = np.where(n_in[:, None] > 0, sums / np.maximum(n_in, 1)[:, None], self.centroids)
        ends = [*range(COLUMNS, d, COLUMNS), d]
        #: (end of a block of columns, most of the limit that a vector within it has shown by then).
        self.blocks = [(e, beta_quantile(e / 2, (d - e) / 2, 1 - ALPHA) if e < d else 1.0) for e in ends]
        self.slack = 1e-9 * max(longest, 1e-300)

    def measured(self, sizes: np.ndarray, means: np.ndarray, variances: np.ndarray, furthest: np.ndarray) -> None:
        """Number of vectors of each list, and mean, variance and maximum of their squared distance to its centroid."""
        self.sizes, self.means, self.variances, self.radii = sizes, means, variances, np.sqrt(furthest)
        # Near lists share bins: they go in order along the centroids' widest direction.
        middle = self.centroids - self.centroids.mean(axis=0)
        order = np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")
        self.bins, self.parts = np.zeros(len(sizes), dtype=np.int32), np.ones(len(sizes), dtype=np.int32)
        at, held = 0, 0
        for i in order:
            if held and held + sizes[i] > POINTS:
                at, held = at + 1, 0
            self.bins[i], held = at, held + sizes[i]
            self.parts[i] = -(-int(sizes[i]) // POINTS)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more]) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids."""
        return np.maximum((x * x).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T, 0)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, and the squared distance to it."""
        near, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for i in range(0, len(x), 1024):
            d = self.distances(x[i : i + 1024])
            near[i : i + 1024] = d.argmin(axis=1)
            far[i : i + 1024] = d.min(axis=1)
        return near, far

    def probes(self, y: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
        """For each turned query: its lists, those densest in expected hits first, and how many are of the first pass."""
        a = self.distances(y)
        mean = a + self.means
        spread = np.sqrt(self.variances + 4 * a * self.means / y.shape[1]) + 1e-12 * max(self.longest, 1e-300)
        low, high = (mean - 9 * spread).min(axis=1), (mean + 9 * spread).max(axis=1)
        for _ in range(40):  # the distance within which k vectors are expected
            limit = (low + high) / 2
            over = (self.sizes * below((limit[:, None] - mean) / spread)).sum(axis=1) > k
            low, high = np.where(over, low, limit), np.where(over, limit, high)
        share = below((high[:, None] - mean) / spread)
        order = np.lexsort((a, -share), axis=1)
        held = np.cumsum(self.sizes[order], axis=1)
        hits = np.cumsum(np.take_along_axis(share * self.sizes, order, axis=1), axis=1)
        n = 1 + (hits < (1 - MISSED) * hits[:, -1:]).sum(axis=1)
        n = np.minimum(np.maximum(n, 1 + (held <= k).sum(axis=1)), len(self.sizes))
        first = np.minimum(1 + (held < max(2 * k, min(FIRST, self.sizes.sum() * FIRST_SHARE))).sum(axis=1), n)
        return [(o[:m], int(f)) for o, m, f in zip(order, n, first)]


def adaptive_scan(x: np.ndarray, y: np.ndarray, limits: np.ndarray, blocks: list[tuple[int, float]], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(point, query, squared distance) of pairs that no test abandons, and the number of components read.

    ``limits`` has one squared distance for each query.  All pairs are read
    from the first block of columns on and tested after each; while many are
    left, a block is one matrix product, then only pairs that are left are read.
    """
    part, left, at, read = 0.0, None, 0, 0
    for i, (end, most) in enumerate(blocks):
        a, b = x[:, at:end], y[:, at:end]
        part = part + (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
        read += part.size * (end - at)
        fine = part <= limits * most + slack
        left, at = fine if left is None else fine & left, end
        if np.count_nonzero(left) <= SPARSE * left.size:
            break
    places = np.flatnonzero(left)
    del left
    kept: list[tuple] = []
    for start in range(0, len(places), PAIRS):
        p, q = np.divmod(places[start : start + PAIRS], part.shape[1])
        d, c = part[p, q], at
        for end, most in blocks[i + 1 :]:
            if not len(p):
                break
            step = x[p, c:end] - y[q, c:end]
            read += step.size
            d = d + np.einsum("nd,nd->n", step, step)
            stay = d <= limits[q] * most + slack
            p, q, d, c = p[stay], q[stay], d[stay], end
        kept.append((p, q, d))
    if not kept:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), read
    return *map(np.concatenate, zip(*kept)), read


class Scanner:
    """Scans the lists of one bin for a chunk of queries, carrying each query's k best distances."""

    def __init__(self, lists: Lists, k: int):
        self.lists, self.k = lists, k
        self.read = self.whole = 0

    def scan(self, x: np.ndarray, own: np.ndarray, rep: np.ndarray, y: np.ndarray, asked: list[np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, query, squared distance) that may be among the k nearest.

        ``own`` is each point's list, ``asked`` each query's lists; points and
        queries are turned.  Only representatives set limits.
        """
        of = self.lists
        best = np.full((len(y), self.k), np.inf)
        limits = limits.copy()
        owner = np.repeat(np.arange(len(y)), [len(z) for z in asked])
        names = np.concatenate([*asked, np.zeros(0, dtype=np.int64)])
        found: list[tuple] = []
        for name in np.unique(own):
            points, queries = np.flatnonzero(own == name), owner[names == name]
            self.whole += len(points) * len(queries) * x.shape[1]
            gap = np.sqrt(((y[queries] - of.centroids[name]) ** 2).sum(axis=1)) - of.radii[name]
            queries = queries[(gap <= 0) | (gap * gap <= limits[queries] * (1 + 1e-9) + of.slack)]
            if not len(queries):
                continue
            p, q, d, read = adaptive_scan(x[points], y[queries], limits[queries], of.blocks, of.slack)
            self.read += read
            if not len(p):
                continue
            found.append((points[p], queries[q], d))
            # The k least of those held and those met, for queries that met any.
            met, place = np.unique(q, return_inverse=True)
            new = np.full((len(met), len(points)), np.inf)
            good = rep[points[p]]
            new[place[good], p[good]] = d[good]
            both = np.concatenate([best[queries[met]], new], axis=1)
            best[queries[met]] = np.partition(both, self.k - 1, axis=1)[:, : self.k]
            limits[queries[met]] = np.minimum(limits[queries[met]], best[queries[met]].max(axis=1))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
        p, q, d = (np.concatenate(z) for z in zip(*found))
        stay = d <= limits[q] + of.slack
        return p[stay], q[stay], d[stay]


def _hits(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """(q1, q2, vid, score): at least each query vector's k best ids found, for vectors of one length."""
    spark = rows.sparkSession
    points = staged(with_representatives(staged(distinct_vectors(rows, k), "distinct")), "points")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = points.agg(F.count("*"), F.max(squares)).first()
    sample = points.orderBy("h1", "h2").select("vec").limit(SAMPLE).toArrow()
    lists = Lists(_matrix(sample.column(0).combine_chunks()), float(longest), int(n))
    fitted = spark.sparkContext.broadcast(lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, far = fitted.value.nearest(fitted.value.turned(_matrix(b.column(1))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(far)], names=["ids", "vec", "rep", "list", "far"])

    dealt = staged(points.select("ids", "vec", "rep").mapInArrow(assign, "ids array<long>, vec array<double>, rep boolean, list int, far double"), "lists")
    held = np.zeros((4, len(lists.centroids)))
    for r in dealt.groupBy("list").agg(F.count("*"), F.avg("far"), F.var_pop("far"), F.max("far")).collect():  # MOST_LISTS at most
        held[:, r[0]] = r[1:]
    lists.measured(*held)
    shared = spark.sparkContext.broadcast(lists)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, AT_A_TIME):
                b, of = whole.slice(i, AT_A_TIME), shared.value
                passes: list[list] = [[], []]
                for order, first in of.probes(of.turned(_matrix(b.column(2)), query=True), k):
                    for out, some in zip(passes, (order[:first], order[first:])):
                        bins = of.bins[some]
                        out.append([{"bin": int(x), "lists": some[bins == x]} for x in np.unique(bins)])
                kind = pa.list_(pa.struct([("bin", pa.int32()), ("lists", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(z, kind) for z in passes)], names=["h1", "h2", "vec", "first", "rest"])

    vectors = points.join(wanted.select("q1", "q2").distinct(), (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).select("h1", "h2", "vec")
    asks = "array<struct<bin int, lists array<int>>>"
    asks = staged(vectors.mapInArrow(choose, f"h1 long, h2 long, vec array<double>, first {asks}, rest {asks}"), "probes")
    table = [(int(i), int(lists.bins[i]), int(lists.parts[i])) for i in np.flatnonzero(lists.sizes)]
    places = F.broadcast(spark.createDataFrame(table, "name int, bin int, blocks int"))  # one row for each list
    placed = staged(dealt.join(places, F.col("list") == F.col("name")).select("bin", "blocks", "list", "ids", "vec", "rep"), "bins")

    def scan(p: pa.Table, q: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()))
        if p.num_rows and q.num_rows:
            of = shared.value
            ids, rep = p.column("ids").to_pylist(), p.column("rep").to_numpy()
            x, y = _matrix(p.column("vec").combine_chunks()), _matrix(q.column("vec").combine_chunks())
            asked = [np.array(z) for z in q.column("lists").to_pylist()]
            at, of_query, d = Scanner(of, k).scan(of.turned(x), p.column("list").to_numpy(), rep, of.turned(y, query=True), asked, q.column("limit").to_numpy())
            score = np.einsum("nd,nd->n", x[at], y[of_query])
            first = np.array([z[0] for z in ids])[at]
            h1, h2 = q.column("h1").to_pylist(), q.column("h2").to_pylist()
            order = np.lexsort((first, -score, of_query))
            now, met = -1, set()
            for j, i, s, e in zip(at[order].tolist(), of_query[order].tolist(), score[order].tolist(), d[order].tolist()):
                if i != now:
                    now, met = i, set()
                # A query's best vectors until they have k ids between them.
                if len(met) < k and not met.issuperset(ids[j]):
                    met.update(ids[j])
                    for column, value in zip(out, (h1[i], h2[i], s, e, rep[j], ids[j])):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["h1", "h2", "score", "far", "rep", "ids"])

    def one_pass(right: DataFrame) -> DataFrame:
        """Blocks of a bin and chunks of its queries: one task for each pair of them."""
        right = right.select("h1", "h2", "vec", "limit", "ask.bin", "ask.lists")
        chunks = placed.groupBy("bin").agg(F.max("blocks").alias("blocks")).withColumnRenamed("bin", "to")
        chunks = chunks.join(right.groupBy("bin").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), F.col("to") == F.col("bin")).drop("bin")
        chunks = F.broadcast(chunks)  # one row for each bin: MOST_LISTS at most
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = placed.drop("blocks").join(chunks, F.col("bin") == F.col("to"))
        left = left.select("bin", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int").alias("block"), every("parts").alias("part"), "list", "ids", "vec", "rep")
        right = right.join(chunks, F.col("bin") == F.col("to"))
        right = right.select("bin", every("blocks").alias("block"), F.pmod(F.col("h1"), F.col("parts")).cast("int").alias("part"), "h1", "h2", "vec", "limit", "lists")
        keys = ("bin", "block", "part")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "h1 long, h2 long, score double, far double, rep boolean, ids array<long>")

    near = staged(one_pass(asks.select("h1", "h2", "vec", F.lit(float("inf")).alias("limit"), F.explode("first").alias("ask"))), "first-hits")
    # No query has more rows here than its bins times k.
    limits = near.where("rep").groupBy(F.col("h1").alias("l1"), F.col("h2").alias("l2")).agg(F.get(F.array_sort(F.collect_list("far")), F.lit(k - 1)).alias("limit"))
    rest = asks.select("h1", "h2", "vec", "rest").where(F.size("rest") > 0).join(limits, (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left")
    rest = staged(rest.select("h1", "h2", "vec", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), F.explode("rest").alias("ask")), "rest-probes")
    found = near.unionByName(one_pass(rest))
    return found.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "score", F.explode("ids").alias("vid"))


def search(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for each distinct id among the rows of ``queries``.

    The ``k`` nearest ids found, each once with its best score, equal scores by
    smaller id; a query's own id is no candidate.  An id with several vectors
    is near where any of them is, as a query too; repeated rows count once.
    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do null ids; vectors of different lengths have no inner product,
    so each length is searched apart.  Other columns are not read.  An empty
    table gives no rows.
    """
    rows = usable(df, id_col, vec_col)
    asking = usable(df.where(queries), id_col, vec_col)
    lengths = [r[0] for r in rows.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]
    kind = "q1 long, q2 long, score double, vid long, query_id long"
    out = df.sparkSession.createDataFrame([], kind)
    for d in lengths:
        of = F.size("vec") == d
        wanted = staged(asking.where(of).select("id", F.xxhash64("vec").alias("q1"), F.xxhash64(F.lit(SEED), "vec").alias("q2")).distinct(), "queries")
        # One more, as the query's own id may be among them.
        out = out.unionByName(_hits(rows.where(of), wanted, k + 1).join(wanted.withColumnRenamed("id", "query_id"), ["q1", "q2"]))
    best = out.where("vid <> query_id").groupBy("query_id", "vid").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vid")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("vid").alias(id_col), "score")
