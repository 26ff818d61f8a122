"""Quality rules as a short-circuit cascade.

A rule looks at one text and says whether it fails.  On a sample of the texts
every rule's cost (CPU seconds) and rejection rate is measured; the cascade
then tries rules in descending order of rejections per second, and a text
that fails one is not shown to the rest.  The verdict is the conjunction of
all rules, so the order (which depends on clocks) changes cost, never results.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Longest text in a sample, and the sample's seed.
SAMPLE_CHARS, SEED = 1 << 20, 11


class TextView:
    """One text; what rules measure of it is computed when first asked for, once."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if x.strip(SPACE)]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen, n, covered = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if seen[x] > 1:
                n += i + 3 - max(i, covered)
                covered = i + 3
        return n

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))

    @cached_property
    def n_lower(self) -> int:
        return sum(map(str.islower, self.text))


@dataclass(frozen=True)
class Rule:
    """``fails(view)`` is true for a text to reject."""

    name: str
    fails: Callable[[TextView], bool]


#: The two base rules.
BASE = (
    Rule("few_words", lambda v: v.n_words < 50),
    Rule("repeated_words", lambda v: 100 * v.n_repeat_words > 50 * v.n_words),
)
#: Rules of the usual web-text filters; thresholds far from ordinary prose.
RULES = BASE + (
    Rule("many_symbols", lambda v: 10 * v.n_symbols > 2 * v.n_words),
    Rule("word_length", lambda v: not 2 * v.n_words <= v.word_chars <= 12 * v.n_words),
    Rule("duplicate_lines", lambda v: 2 * v.n_dup_lines > v.text.count("\n") + 1),
    Rule("shouting", lambda v: v.n_upper > v.n_lower),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    rejection: float

    @property
    def worth(self) -> float:
        return self.rejection / max(self.seconds, 1e-9)


def estimate(texts: Sequence[str | None], rules: Sequence[Rule] = RULES) -> list[RuleEstimate]:
    """Mean cost and rejection rate of every rule on sampled texts (none: all zero)."""
    out = []
    for rule in rules:
        views = [TextView(x) for x in texts]
        began = time.process_time()
        failed = sum(rule.fails(v) for v in views)
        n = max(len(views), 1)
        out.append(RuleEstimate(rule.name, (time.process_time() - began) / n, failed / n))
    return out


def cascade_order(estimates: Sequence[RuleEstimate]) -> list[str]:
    """Rule names by rejections per second, most first; ties by name."""
    return [e.name for e in sorted(estimates, key=lambda e: (-e.worth, e.name))]


def sample_texts(docs: DataFrame, text_col: str, sample_rows: int) -> list[str | None]:
    """About ``sample_rows`` texts of up to ``SAMPLE_CHARS`` characters, drawn from all rows, for estimates alone.

    Each row is drawn with the same chance; twice as many as asked are never
    taken.  The sample steers the order of rules, which no verdict depends on.
    """
    n = docs.count()
    some = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).sample(min(1.0, sample_rows / max(n, 1)), SEED)
    return [r["text"] for r in some.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).limit(2 * sample_rows).collect()]


def quality_cascade(
    docs: DataFrame,
    text_col: str = "text",
    rules: Sequence[Rule] = RULES,
    sample_rows: int = 200,
    measures: bool = False,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``kept``, ``failed_rule`` (null if kept) and ``rules_tried``.

    ``kept`` is the same in every run.  ``failed_rule`` names the first rule
    that the cascade saw fail and ``rules_tried`` how many it tried: they tell
    of its order, which clocks decide, so they can differ between runs.  A
    null or empty text has no words; repeated rows are judged alike.  ``measures`` appends the five counts
    of ``MEASURES`` as well, and ``base_failed``; they are taken of every text,
    after the cascade.  ``keep`` names the columns that stay; same-named
    columns are replaced.  Only the cost estimate is sampled: every row is
    judged by its whole text.
    """
    order = cascade_order(estimate(sample_texts(docs, text_col, sample_rows), rules))
    by_name = {r.name: r for r in rules}
    ordered = [by_name[n] for n in order]
    fields = [T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType()), T.StructField("rules_tried", T.IntegerType())]
    if measures:
        fields += [T.StructField(m, T.LongType()) for m in MEASURES] + [T.StructField("base_failed", T.BooleanType())]

    def make() -> Callable[[pa.Array], list]:
        def judge(texts: pa.Array) -> list:
            out: list[list] = [[] for _ in fields]
            for x in texts:
                view = TextView(x.as_py())
                failed, tried = None, 0
                for rule in ordered:
                    tried += 1
                    if rule.fails(view):
                        failed = rule.name
                        break
                row = [failed is None, failed, tried]
                if measures:
                    row += [getattr(view, m) for m in MEASURES] + [any(r.fails(view) for r in BASE)]
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return judge

    return annotate(docs, text_col, make, fields, keep)
