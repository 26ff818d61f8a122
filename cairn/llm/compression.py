"""A quality classifier that compresses.

Two zstandard dictionaries are built, from labelled good and from labelled bad
text.  A text that is compressed better by the good one resembles good text:
the normalised difference of the two compressed sizes is the only feature, and
a logistic curve fitted on other labelled rows turns it into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import annotate

DICTIONARY_BYTES, LEVEL = 112_640, 3
#: The dictionary builder's segments and the substrings it scores them by, in bytes.  Short segments leave the dictionary of
#: repetitive texts far smaller than the other, which tilts the difference.
SEGMENT, SUBSTRING = 768, 8


def _dictionary(texts: Sequence[bytes]) -> bytes:
    """Trained on the texts in pieces of 4 KB; too little to train on: the texts themselves."""
    pieces = [t[i : i + 4096] for t in texts for i in range(0, len(t), 4096)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=SEGMENT, d=SUBSTRING).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


@dataclass(frozen=True)
class Classifier:
    """Two dictionaries and the curve: probability = 1 / (1 + exp(-(slope * x + base)))."""

    good: bytes
    bad: bytes
    slope: float
    base: float

    def scorer(self):
        tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False) for d in (self.good, self.bad)]

        def feature(text: str | None) -> float:
            raw = (text or "").encode("utf-8", "surrogatepass")
            g, b = (len(t.compress(raw)) for t in tools)
            return (b - g) / (b + g)

        return feature

    def probability(self, x: float) -> float:
        z = self.slope * x + self.base
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton steps on the penalised likelihood, the feature scaled to unit spread."""
    spread = x.std() or 1.0
    a = np.column_stack([x / spread, np.ones(len(x))])
    # Targets a little inside 0 and 1 keep separable data finite.
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t, w = np.where(y > 0, up, down), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), a.T @ (t - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def fit(rows: Sequence[tuple[str | None, int]], totals: tuple[int, int] | None = None) -> Classifier:
    """From (text, label) in a fixed order: alternate rows of a class build its dictionary and fit the curve.

    ``totals`` has the numbers of labels 0 and 1 of which ``rows`` are a
    sample; the curve's base is moved by the logarithm of what the sample
    changed in their ratio, so scores keep to the labels' share.  Without rows
    of both classes the score is the same for every text: the smoothed share
    of label 1.
    """
    build: dict[int, list[bytes]] = {0: [], 1: []}
    held: list[tuple[str | None, int]] = []
    seen = [0, 0]
    for text, label in rows:
        seen[label] += 1
        if seen[label] % 2:
            build[label].append((text or "").encode("utf-8", "surrogatepass"))
        else:
            held.append((text, label))
    of = totals or tuple(seen)
    share = math.log((of[1] + 1) / (of[0] + 1))
    good, bad = _dictionary(build[1]), _dictionary(build[0])
    n = [sum(label == c for _, label in held) for c in (0, 1)]
    if not all(n):
        return Classifier(good, bad, 0.0, share)
    feature = Classifier(good, bad, 0.0, 0.0).scorer()
    x, y = np.array([feature(t) for t, _ in held]), np.array([label for _, label in held])
    slope, base = _curve(x, y)
    return Classifier(good, bad, slope, base + math.log(max(of[1], 1) / max(of[0], 1) * n[0] / n[1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows_each: int, bytes_each: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str | None, int]], tuple[int, int]]:
    """Labelled texts, and the numbers of all ids with label 0 and label 1.

    Of each class, those of the least id hash: up to ``rows_each`` ids, as far
    as their texts hold ``bytes_each`` bytes together.  Ids with both labels,
    null ids and ids without a document count for neither.  An id on several
    rows counts once, with its least text.  The chosen ids (a bounded set) are
    broadcast to one scan of the documents.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("most")).where("label = most").select("id", "label")
    counted = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("id")
    some = [known.where(F.col("label") == c).orderBy(order, "id").limit(rows_each) for c in (0, 1)]
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = slim.join(F.broadcast(some[0].union(some[1])), F.col("doc") == F.col("id"))
    one = found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("label").orderBy(order, "id"))
    rows = one.withColumn("upto", upto).where(F.col("upto") <= bytes_each).select("id", "text", "label").collect()
    rows.sort(key=lambda r: (r["id"], r["text"] or ""))
    return [(r["text"], r["label"]) for r in rows], (counted.get(0, 0), counted.get(1, 0))


def score_quality(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``size_difference`` and ``score`` (0 to 1) of every whole text; null counts as empty.

    Equal texts have equal scores; every row keeps its place, and same-named
    columns are replaced.
    """
    fields = [T.StructField("size_difference", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def make():
        feature = model.scorer()

        def judge(texts):
            x = [feature(t.as_py()) for t in texts]
            return [x, list(map(model.probability, x))]

        return judge

    return annotate(docs, text_col, make, fields, keep)
