"""Recall, exact match and token F1; gold passages and answers of question files."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from lorewell.functions.text import normalize_answer

#: Fixed: the cutoffs at which recall is reported.
RECALL_AT = (1, 2, 5, 10, 20, 30, 50, 100, 150, 200)


class Metric(Protocol):
    """Pooled results and results per example."""

    def scores(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]: ...


def recall(docs: Column, gold: Column, k: int) -> Column:
    """Share of the distinct gold passages among the first k; 0 without gold."""
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(docs, 1, k), gold)) / n).otherwise(F.lit(0.0))


def recall_at_k(rows: DataFrame, ks: tuple[int, ...] = RECALL_AT) -> tuple[DataFrame, DataFrame]:
    """Pooled (k, recall; four places) and per example (query_id, k, recall) of rows (query_id, docs, gold)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), recall(F.col("docs"), F.col("gold"), k).alias("recall")) for k in sorted(set(ks))]))
    single = rows.select("query_id", each.alias("x")).select("query_id", "x.k", "x.recall")
    return single.groupBy("k").agg(F.round(F.avg("recall"), 4).alias("recall")), single


def exact_match(predicted: Column, golds: Column, aggregate=F.array_max) -> Column:
    """1 if the normalised answer equals a normalised gold answer; ``aggregate`` works on the list over golds."""
    own = normalize_answer(predicted)
    return F.coalesce(aggregate(F.transform(golds, lambda g: (normalize_answer(g) == own).cast("double"))), F.lit(0.0))


def _f1(a: Column, b: Column) -> Column:
    words = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")
    p, g = words(a), words(b)
    count = lambda ws, t: F.size(F.filter(ws, lambda x: x == t))
    common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))
    return F.when(common > 0, 2 * common / (F.size(p) + F.size(g))).otherwise(F.lit(0.0))


def token_f1(predicted: Column, golds: Column, aggregate=F.array_max) -> Column:
    """Harmonic mean of token precision and recall, tokens counted as often as they occur in both."""
    return F.coalesce(aggregate(F.transform(golds, lambda g: _f1(predicted, g))), F.lit(0.0))


def qa_scores(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pooled (ExactMatch, F1; four places) and per example of rows (query_id, answer, gold_answers)."""
    single = rows.select("query_id", exact_match(F.col("answer"), F.col("gold_answers")).alias("em"), token_f1(F.col("answer"), F.col("gold_answers")).alias("f1"))
    return single.agg(F.round(F.avg("em"), 4).alias("ExactMatch"), F.round(F.avg("f1"), 4).alias("F1")), single


def sentence_separator(dataset: str) -> str:
    """What stands between the sentences of a context: nothing in hotpotqa, else a space."""
    return "" if dataset.startswith("hotpotqa") else " "


def gold_docs(rows: DataFrame, separator: str = " ") -> DataFrame:
    """id, gold: the supporting passages of questions, from whichever of the three shapes they have.

    ``supporting_titles`` with ``context`` (title, sentences; joined by
    ``separator``), ``contexts``, or ``paragraphs`` (text or paragraph_text); a paragraph
    without the flag counts as supporting.
    """
    doc = lambda t, x: F.concat(t, F.lit("\n"), x)
    by_title = F.transform(F.filter("context", lambda c: F.array_contains("supporting_titles", c["title"])), lambda c: doc(c["title"], F.array_join(c["sentences"], separator)))
    flagged = lambda c: F.filter(c, lambda p: F.coalesce(p["is_supporting"], F.lit(True)))
    by_context = F.transform(flagged("contexts"), lambda p: doc(p["title"], p["text"]))
    by_paragraph = F.transform(flagged("paragraphs"), lambda p: doc(p["title"], F.coalesce(p["text"], p["paragraph_text"])))
    chosen = F.when(F.col("supporting_titles").isNotNull(), by_title).when(F.col("contexts").isNotNull(), by_context).otherwise(by_paragraph)
    return rows.select("id", F.array_distinct(F.coalesce(chosen, F.array().cast("array<string>"))).alias("gold"))


def gold_answers(rows: DataFrame) -> DataFrame:
    """id, answers: the first answer field there is, and the aliases."""
    empty = F.array().cast("array<string>")
    objects = F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in ("obj", "possible_answers", "o_wiki_title", "o_aliases")]))
    first = F.coalesce("answer", "gold_ans", "reference", objects)
    return rows.select("id", F.array_union(first, F.coalesce("answer_aliases", empty)).alias("answers"))
