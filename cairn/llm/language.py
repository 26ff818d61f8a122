"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point.  An
n-gram's vector binds (multiplies) its letters' vectors, each rotated by its
place.  A text's vector is the bundle (sum) of its n-grams' vectors; a language
prototype is the bundle of its training texts' vectors, each of unit length.
A text is compared with all prototypes by cosine, after the mean of the
prototypes (what all languages share) is taken off both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

DIMENSIONS, NGRAM, SEED = 512, 3, 20240607
#: Fixed-point scale of training sums, which makes them exact in any order.
SCALE = 1 << 20
#: Prototypes are sent to tasks: more languages than this are an error.
MOST_LANGUAGES = 10_000
#: Letters kept by a task (at least those of the text in hand), and n-grams bound at a time.
LETTERS, BLOCK = 4096, 256
#: Scores are shares of exp(SHARPNESS * cosine).
SHARPNESS = 3.0
#: Cosine below which a text is no nearer to a prototype than by chance: three
#: deviations of the cosine of two random vectors.
CHANCE = 3 / DIMENSIONS**0.5
_GAPS = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, dtype=np.int8)
    return (2 * bits - 1).astype(np.int8)


class Profiler:
    """Texts to vectors.  Letters met so far are kept as rows, one table for each rotation."""

    def __init__(self) -> None:
        self.codes = np.zeros(0, dtype=np.int64)
        self.tables = [np.zeros((0, DIMENSIONS), dtype=np.int8) for _ in range(NGRAM)]

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code point in the tables, new ones added; an odd mix of scripts starts them anew."""
        distinct = np.unique(codes)
        new = np.setdiff1d(distinct, self.codes, assume_unique=True)
        if len(new):
            keep = self.codes if len(self.codes) + len(new) <= LETTERS else self.codes[:0]
            self.codes = np.sort(np.concatenate([keep, new if len(keep) else distinct]))
            plain = np.array([letter_vector(int(c)) for c in self.codes], dtype=np.int8)
            self.tables = [np.roll(plain, NGRAM - 1 - i, axis=1) for i in range(NGRAM)]
        return np.searchsorted(self.codes, codes)

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a whole text; none if it has no letter."""
        spaced = _GAPS.sub(" ", text or "").lower()
        if not any(map(str.isalpha, spaced)):
            return None
        codes = np.frombuffer(f" {spaced} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        row = self._rows(codes)
        wide = len(self.codes)
        grams, counts = np.unique((row[:-2] * wide + row[1:-1]) * wide + row[2:], return_counts=True)
        total = np.zeros(DIMENSIONS, dtype=np.float64)
        for at in range(0, len(grams), BLOCK):
            g = grams[at : at + BLOCK]
            bound = self.tables[0][g // (wide * wide)] * self.tables[1][g // wide % wide] * self.tables[2][g % wide]
            # einsum runs in this thread; a matrix product would start one on every core.
            total += np.einsum("g,gd->d", counts[at : at + BLOCK].astype(np.float32), bound.astype(np.float32))
        length = np.linalg.norm(total)
        return total / length if length else total


def learn_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", where: Column | None = None) -> dict[str, np.ndarray]:
    """Language -> unit prototype, from all rows of ``where`` with a language and a letter.

    Each task bundles its own rows by language, then sums are added by
    language and dimension; the driver gets one vector for each language.
    More than ``MOST_LANGUAGES`` (more than there are languages) is an error:
    such a column names something else.
    """
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & (F.lit(True) if where is None else where))
    rows = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profiler = Profiler()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (v := profiler.vector(text.as_py())) is not None:
                    part = np.rint(v * SCALE).astype(np.int64)
                    sums[lang] = sums[lang] + part if lang in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "total": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))})

    parts = rows.mapInArrow(bundle, "lang string, total array<long>")
    sums = parts.select("lang", F.posexplode("total").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    found = whole.select("lang", F.col("v.x").alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    out = {}
    for lang, v in sorted(found):
        x = np.array(v, dtype=np.float64)
        out[lang] = x / (np.linalg.norm(x) or 1.0)
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``score`` (0 to 1), ``cosine`` and ``highest`` to every row.

    The nearest prototype by cosine wins, both sides less the mean prototype
    where there are several; ties go by code point.  ``score`` is its
    share of the exponentials of all cosines.  ``cosine`` is that to the
    winner before centring, ``highest`` the greatest to any prototype.  A null
    text, one without a letter, and any text where nothing was learned is
    ``und`` with 0.  Prototypes are sent to every task: ``MOST_LANGUAGES`` of
    4 KB each at most.
    """
    names = sorted(prototypes)
    table = np.array([prototypes[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    centre = table.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    centred = table - centre
    lengths = np.linalg.norm(centred, axis=1)
    centred /= np.where(lengths > 0, lengths, 1.0)[:, None]
    fields = [T.StructField("lang_pred", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in ("score", "cosine", "highest"))]

    def make():
        profiler = Profiler()

        def judge(texts):
            preds, scores, cosines, highest = [], [], [], []
            for x in texts:
                v = profiler.vector(x.as_py())
                if v is None or not names:
                    preds.append("und"), scores.append(0.0), cosines.append(0.0), highest.append(0.0)
                    continue
                shifted = v - centre
                cos = np.einsum("ld,d->l", centred, shifted / (np.linalg.norm(shifted) or 1.0))
                best = int(np.argmax(cos))
                e = np.exp((cos - cos[best]) * SHARPNESS)
                preds.append(names[best]), scores.append(float(1 / e.sum())), cosines.append(float((table[best] * v).sum()))
                highest.append(float(np.einsum("ld,d->l", table, v).max()))
            return [preds, scores, cosines, highest]

        return judge

    return annotate(docs, text_col, make, fields, keep)
