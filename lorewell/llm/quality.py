"""Quality rules whose cutoffs control the risk of rejecting a good document.

Each rule compares one ratio of a document with a cutoff. Labelled documents
serve as holdouts: within a stratum (a language), a cutoff may be used only if
an exact binomial test shows that it rejects less than a share ``alpha`` of the
good documents. Cutoffs are tested from lenient to strict and testing stops at
the first that isn't shown (a fixed sequence needs no correction); the level is
divided by the number of rules and strata (Bonferroni), and the allowed false
rejection by the number of rules, so that with confidence 1 - ``delta`` all
rules together reject at most ``alpha`` of the good documents of every stratum.
Among the cutoffs shown, the most lenient that still catches nearly as many bad
documents as any is taken. Every stratum is tested by itself, however many there
are; one with too few labels gets no cutoff and keeps its documents. The tests
run on the executors, and only the cutoffs found are broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell.llm.arrow import map_batches
from lorewell.llm.rows import Rows
from lorewell.scratch import materialize

#: Fixed by the contract: what counts as white space and as a symbol.
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_bangs", "n_distinct")
#: Cutoffs of a rule.
STEPS = 40


@dataclass(frozen=True)
class Rule:
    """Reject when the ratio is at least (or, with ``low``, at most) the cutoff; cutoffs run from lenient to strict."""

    name: str
    ratio: str
    lenient: float
    strict: float

    def cutoff(self, step: int) -> float:
        return self.lenient + (self.strict - self.lenient) * step / STEPS

    def step(self) -> Column:
        """The first step whose cutoff rejects the document; STEPS + 1 if none does."""
        passed = (F.expr(self.ratio) - F.lit(self.lenient)) / F.lit(self.strict - self.lenient) * F.lit(STEPS)
        return _first_step(passed)


def _first_step(passed: Column) -> Column:
    # passed = 0 at the lenient cutoff, STEPS at the strict one; beyond the lenient end it is negative
    return F.when(passed > STEPS, STEPS + 1).when(passed <= 0, 0).otherwise(F.ceil(passed)).cast("int")


RULES = (
    Rule("symbols", "n_symbols / n_words", 2.0, 0.02),
    Rule("upper_words", "n_upper_words / n_words", 1.0, 0.05),
    Rule("exclamations", "n_bangs / n_words", 2.0, 0.05),
    Rule("repeated_words", "n_repeat_words / n_words", 0.5, 0.05),
    Rule("repeated_lines", "n_dup_lines / n_lines", 1.0, 0.05),
    Rule("long_words", "word_chars / n_words", 20.0, 6.0),
    Rule("short_words", "word_chars / n_words", 1.0, 4.0),
    Rule("few_words", "n_distinct / n_words", 0.02, 0.5),
)


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; a null text has no words."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    repeated = 0
    if len(at) > 3:
        n = len(ids)
        pair = at[:-2] * n + at[1:-1]
        if n >= 1 << 21:  # else the key of three words fits in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        _, window, found = np.unique(pair * n + at[2:], return_inverse=True, return_counts=True)
        often = found[window] > 1
        if often.any():
            covered = np.zeros(len(at), bool)
            for k in range(3):
                covered[k : len(at) - 2 + k] |= often
            repeated = int(covered.sum())
    return (
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(lines), sum(map(bytes.isupper, words)), text.count("!"), len(ids),
    )


def counted(rows: DataFrame) -> DataFrame:
    """The columns of ``rows`` but ``text``, and the COUNTS of that, as a written table."""
    others = rows.drop("text").dtypes
    names = [n for n, _ in others]

    def make():
        def each(b: pa.RecordBatch) -> list:
            found = [measure(x.as_py()) for x in b.column("text")]
            return [*[b.column(c) for c in names], *(zip(*found) if found else [[]] * len(COUNTS))]

        return each

    kept = [f"{n} {t}" for n, t in others]
    return materialize(map_batches(rows, make, ", ".join([*kept, *[f"{c} long" for c in COUNTS]])), "counts")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly, as a regularised incomplete beta function."""
    if k >= n:
        return 1.0
    if k == 0:
        return math.exp(n * math.log1p(-p))
    a, b, x = float(n - k), float(k + 1), 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h


def choose_step(good: list[int], bad: list[int], alpha: float, level: float) -> int | None:
    """The step to use, from the number of good and bad documents by first rejecting step; None if no cutoff is shown safe."""
    n, rejected, caught, shown = sum(good), 0, 0, []
    for step in range(STEPS + 1):
        rejected, caught = rejected + good[step], caught + bad[step]
        if not n or binomial_tail(rejected, n, alpha) > level:
            break
        shown.append(caught)
    if not shown or not shown[-1]:
        return None
    return next(i for i, x in enumerate(shown) if x >= 0.99 * shown[-1])


def _stratum(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit("~none")) if "lang" in docs.columns else F.lit("~all")


def fit(found: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> DataFrame:
    """stratum and a column for each rule with its cutoff there (null: none), of the strata with any, from all labelled documents.

    ``found``: doc_id, stratum and the COUNTS; ``labels``: doc_id, quality (1: good).
    """
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = found.where("n_words > 0").join(label, "doc_id").select("stratum", "quality", *[r.step().alias(r.name) for r in RULES])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r.name).alias("step")) for i, r in enumerate(RULES)]))
    cells = seen.select("stratum", (F.col("quality") > 0).alias("good"), each.alias("x")).groupBy("stratum", "good", "x.rule", "x.step")
    cells = materialize(cells.agg(F.count(F.lit(1)).alias("n")), "cells")
    level = delta / (len(RULES) * max(1, cells.select("stratum").distinct().count()))

    def make():
        def choose(b: pa.RecordBatch) -> list:
            steps = []
            for own in b.column("cells").to_pylist():
                t = np.zeros((2, STEPS + 2), np.int64)
                for x in own:
                    t[int(x["good"]), x["step"]] = x["n"]
                steps.append(choose_step(t[1].tolist(), t[0].tolist(), alpha / len(RULES), level))
            rules = b.column("rule").to_pylist()
            return [b.column("stratum"), rules, [None if x is None else RULES[i].cutoff(x) for i, x in zip(rules, steps)]]

        return choose

    tables = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("good", "step", "n")).alias("cells"))  # 2 * (STEPS + 2) at most
    chosen = map_batches(tables, make, "stratum string, rule int, cutoff double").where("cutoff is not null")
    return chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == i, F.col("cutoff"))).alias(r.name) for i, r in enumerate(RULES)])


def with_rejected(found: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add a column ``rejected``: whether the rules of a row's stratum reject it; needs columns ``stratum`` and the COUNTS.

    The cutoffs are broadcast, as a stratum may have most rows; there is one row for some 1,150 good labels at most.
    """
    own = cutoffs.select("stratum", F.struct(*[r.name for r in RULES]).alias("_cut"))
    broken = F.lit(False)
    for r in RULES:
        ratio, cut = F.expr(f"if(n_words > 0, {r.ratio}, null)"), F.col("_cut")[r.name]  # hoisted out of the conjunction, it meets rows without words
        broken = broken | F.coalesce(ratio >= cut if r.strict < r.lenient else ratio <= cut, F.lit(False))
    return found.join(F.broadcast(own), "stratum", "left").withColumn("rejected", broken)


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum; one row per input row.

    A null or empty text has no words and fails the base rule. Repeated rows
    are judged alike; a null doc_id has no label. Without labels, or with too
    few, only the base rule rejects. Texts of any length are measured whole.
    An empty table gives an empty result; beyond lang (if there is one) no other
    column is read.
    """
    found = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _stratum(docs).alias("stratum")))
    kept = ~_base_failed() & ~F.col("rejected")
    return with_rejected(found, fit(found, labels, alpha, delta)).select("doc_id", *COUNTS[:5], _base_failed().alias("base_failed"), kept.alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.1) -> DataFrame:
    """The documents that all rules keep, with all columns of ``docs``.

    Each row is judged by itself, as in ``verdicts``: a null or empty text goes,
    repeated rows stay or go together, and long texts are measured whole, once.
    An empty table gives an empty result; no column can clash.
    """
    table = Rows(docs)
    found = counted(table.pick(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), _stratum(docs).alias("stratum")))
    good = with_rejected(found, fit(found, labels, alpha, delta)).where(~_base_failed() & ~F.col("rejected"))
    return table.keep(good)
