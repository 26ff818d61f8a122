"""Language-model scoring by subword lattices.

The vocabulary of a public subword tokenizer is taken as it is.  Its pieces
get unigram scores from the distinct training words.  The probability of a word's spelling is the sum over ALL
its segmentations into pieces, by a forward recursion in log space; bytes
stand in for characters without a piece, and a stop closes every word, so
spellings have total probability one.  A word seen in training is one more
arc of its lattice: with c of N tokens, V distinct tokens and the discount
d = n1 / (n1 + 2 n2), from the numbers of tokens seen once and twice,

    P(word) = (max(c - d, 0) + d * V * P_lattice(word)) / N

and the end of a text, which has no spelling, (c - d) / N.  A text's score is
the sum of log10 P over its words and end.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, staged

#: A word of at most so many bytes with more than this share of all tokens is
#: frequent: at most 1 / share of them, 6 MB of letters, which is broadcast.
FREQUENT_SHARE, FREQUENT_BYTES = 1e-5, 64
#: Bytes of words, about, that a task counts before it passes them on; what an entry takes besides its letters.
HELD, ENTRY = 1 << 25, 120
#: Distinct words in one batch sent on.
SENT = 20_000
END = b""
#: Fixed-point scale of the terms that cross a shuffle.
FIXED = 10**9
LOG10 = math.log(10)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Lattice:
    """Log probabilities of pieces (natural), and of bytes, and the forward recursion."""

    MARK = "▁"

    def __init__(self, pieces: dict[str, float], byte_logs: list[float], stop: float):
        self.byte_logs, self.stop = byte_logs, stop
        # Every prefix of a piece; none where no piece ends.
        self.arcs: dict[str, float | None] = {x[:i]: None for x in pieces for i in range(1, len(x))}
        self.arcs |= pieces

    def log_probability(self, word: bytes) -> float:
        """Log of the sum over all segmentations of a word's spelling."""
        s = self.MARK + word.decode("utf-8", "replace")
        n, get, exp, log = len(s), self.arcs.get, math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        forward = 0.0
        for start in range(n):
            into[start + 1].append(forward + sum([self.byte_logs[b] for b in s[start].encode()]))
            for end in range(start + 1, n + 1):
                p = get(s[start:end], 0.0)
                if p == 0.0:  # no piece has probability one
                    break
                if p is not None:
                    into[end].append(forward + p)
            at = into[start + 1]
            top = max(at)
            forward = top + log(sum([exp(a - top) for a in at])) if len(at) > 1 else top
        return forward + self.stop


def token_counts(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """(word, c, total): every distinct token's count in training rows and in all rows.

    Tasks count their own texts first, so a frequent word crosses the shuffle
    once for each ``HELD`` bytes of words, not once for each use.  The end of
    a text is the empty word.
    """
    rows = docs.select(F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def flush(seen: list[Counter]) -> Iterator[pa.RecordBatch]:
        learned, other = seen[1], seen[0]
        words = list(learned.keys() | other.keys())
        for at in range(0, len(words), SENT):
            part = words[at : at + SENT]
            c = np.fromiter((learned[w] for w in part), np.int64, len(part))
            total = c + np.fromiter((other[w] for w in part), np.int64, len(part))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(c), pa.array(total)], names=["word", "c", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [Counter(), Counter()], 0
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, mine = words_of(text.as_py()), seen[t]
                before = len(mine)
                mine.update(words)
                mine[END] += 1
                if len(mine) > before:
                    held += ENTRY * (len(mine) - before) + sum(map(len, words))
                if held > HELD:
                    yield from flush(seen)
                    seen, held = [Counter(), Counter()], 0
        yield from flush(seen)

    counted = rows.mapInArrow(run, "word binary, c long, total long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def fit_lattice(counts: DataFrame, vocabulary: str | None = None) -> Lattice:
    """Unigram scores of an existing vocabulary's pieces, from all training words.

    Each distinct word is cut once, by the library, and counts once: the
    lattice speaks for unseen words, which resemble kinds of words, not uses.
    One is added for every piece.  At most one row for
    each piece of the vocabulary reaches the driver.
    """
    path = vocabulary or default_pieces()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, sums = _library(path), Counter()
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids in lib.encode(words, num_threads=1):
                for i in ids:
                    sums[i] += 1
                sums[-1] += 1
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(sums.keys(), pa.int32()), "n": pa.array(sums.values(), pa.int64())})

    learned = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word")
    found = {r[0]: r[1] for r in learned.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n")).collect()}
    lib = _library(path)
    usable = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
    total = math.log(sum(found.values()) + len(usable) + 1)
    log_of = lambda i: math.log(found.get(i, 0) + 1) - total
    pieces = {lib.id_to_piece(i): log_of(i) for i in usable if not lib.is_byte(i)}
    byte_logs = [log_of(lib.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
    return Lattice(pieces, byte_logs, log_of(-1))


def word_scores(counts: DataFrame, lattice: Lattice, n: int, v: int, discount: float) -> DataFrame:
    """(word, total, known, base, score): log10 probabilities of every distinct token, both models."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def score(word: bytes, c: int, lat: Lattice) -> float:
        if word == END:
            return math.log10((c - discount) / n) if c else 0.0
        log_p = lat.log_probability(word)
        if c:
            return math.log10((c - discount + discount * v * math.exp(log_p)) / n)
        return log_p / LOG10 + (math.log10(discount * v / n) if n else 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, seen = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            base = [math.log10((c + 1) / (n + v + 1)) for c in seen]
            scores = [score(w, c, shared.value) for w, c in zip(words, seen)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c > 0 for c in seen], pa.bool_()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=["word", "total", "known", "base", "score"])

    return counts.select("word", "c", "total").mapInArrow(run, "word binary, total long, known boolean, base double, score double")


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Null and empty texts have the end token alone; a null in ``train`` means
    no training.  Without training rows words have their lattice's probability
    and the end counts as certain.  Frequent
    words are scored where the text is read, from a broadcast table of at most
    1 / FREQUENT_SHARE words; each distinct rare word of a text is joined with
    its score.  Sums are of rounded fixed-point terms where they cross the
    shuffle, so reruns agree.  Other columns are not read.
    """
    counts = staged(token_counts(docs, train, text_col), "lm-counts")
    row = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("total"), F.count(F.when(F.col("c") == 1, 1)), F.count(F.when(F.col("c") == 2, 1))).first()
    n, v, everything, once, twice = (int(x or 0) for x in row)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    lattice = fit_lattice(counts, vocabulary)
    scored = staged(word_scores(counts, lattice, n, v, discount), "lm-words")
    often = (F.col("total") > everything * FREQUENT_SHARE) & (F.octet_length("word") <= FREQUENT_BYTES)
    frequent = {r[0]: (r[1], r[2], r[3]) for r in scored.where(often).select("word", "known", "base", "score").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    # Numbers of rows: made once, as the table of frequent sums is written.
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.monotonically_increasing_id().alias("k"))
    kind = slim.schema["id"]
    schema = T.StructType([
        T.StructField("id", kind.dataType), T.StructField("k", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))),
    ])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, none = shared.value, (None, 0.0, 0.0)
        for whole in batches:
            for batch in bounded(whole, 1):
                # The distinct rare words of all texts in flat arrays: their bytes, counts and ends.
                words: list[bytes] = []
                counts, ends = array("q"), array("i", [0])
                sums: list[list] = [[] for _ in range(4)]
                for text in batch.column(1):
                    counted = Counter(words_of(text.as_py()))
                    counted[END] += 1
                    known, base, score = 0, [], []
                    for word, m in counted.items():
                        hit, b, x = table.get(word, none)
                        if hit is None:
                            words.append(word)
                            counts.append(m)
                        else:
                            known += m * hit
                            base.append(m * b)
                            score.append(m * x)
                    ends.append(len(words))
                    for column, value in zip(sums, (counted.total(), known, math.fsum(base), math.fsum(score))):
                        column.append(value)
                pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(np.array(counts, np.int64))], names=["word", "n"])
                rare = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pairs)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, sums, kinds), rare], names=schema.names)

    local = staged(slim.mapInArrow(run, schema), "lm-local")
    rare = local.select("k", F.explode("rare").alias("w")).select("k", F.col("w.word").alias("x"), F.col("w.n").alias("n"))
    words = scored.where(~often).select("word", "known", "base", "score")
    met = rare.join(words, F.col("x") == F.col("word"))
    fixed = lambda c: F.sum(F.col("n") * F.round(F.col(c) * FIXED).cast("long"))
    sums = met.groupBy(F.col("k").alias("j")).agg(F.sum(F.col("n") * F.col("known").cast("long")).alias("known_rare"), fixed("base").alias("base_rare"), fixed("score").alias("score_rare"))
    sums = sums.select("j", "known_rare", (F.col("base_rare") / FIXED).alias("base_rare"), (F.col("score_rare") / FIXED).alias("score_rare"))
    out = local.drop("rare").join(sums, F.col("k") == F.col("j"), "left")
    none = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", none)).alias("base_score"), (F.col("score") + F.coalesce("score_rare", none)).alias("score"),
    )
