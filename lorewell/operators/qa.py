"""Answers to questions with retrieved passages."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lorewell import schemas
from lorewell.config import EngineConfig
from lorewell.functions.text import parse_answer, qa_prompt
from lorewell.operators.calls import ask, chat
from lorewell.operators.models import ChatModel, Reader
from lorewell.sources.files import Tables

DEFAULT = EngineConfig()


def solutions(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, question, docs, doc_scores: each question's passages (rank, content, score) as lists in order."""
    rows = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    lists = rows.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "score"))).alias("d"))
    return lists.select("query_id", "question", F.col("d.content").alias("docs"), F.col("d.score").alias("doc_scores"))


def shown(solved: DataFrame, docs: int = 5, places: int = 4) -> DataFrame:
    """Solutions for display: the first passages, scores rounded."""
    scores = F.transform(F.slice("doc_scores", 1, docs), lambda x: F.round(x, places))
    return solved.withColumns({"docs": F.slice("docs", 1, docs), "doc_scores": scores})


def answered(solved: DataFrame, reader: Reader, facts: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Solutions with prompt, response and answer; ``facts`` (query_id, s, p, o, rank) go to the reader in order."""

    @F.arrow_udf("string")
    def read(questions: pa.Array, docs: pa.Array, known: pa.Array) -> pa.Array:
        rows = zip(questions.to_pylist(), docs.to_pylist(), known.to_pylist())
        return pa.array([reader.answer(q or "", d or [], f or []) for q, d, f in rows], pa.string())

    rows = solved
    if facts is not None:
        lists = facts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.array("s", "p", "o").alias("t")))).alias("f"))
        rows = rows.join(lists.select("query_id", F.col("f.t").alias("facts")), "query_id", "left")
    else:
        rows = rows.withColumn("facts", F.lit(None).cast(schemas.TRIPLES))
    rows = rows.withColumn("prompt", qa_prompt(F.col("docs"), F.col("question"), config.qa_topk))
    rows = rows.withColumn("response", read(F.col("question"), F.slice("docs", 1, config.qa_topk), F.col("facts"))).drop("facts")
    return rows.withColumn("answer", parse_answer(F.col("response")))


def answered_by_prompt(
    solved: DataFrame, model: ChatModel, prompt: list[dict[str, str]], tables: Tables | None = None, config: EngineConfig = DEFAULT
) -> DataFrame:
    """Solutions with prompt, response, answer and what ``ask`` tells of the calls; a failed call has no answer."""
    rows = solved.withColumn("prompt", qa_prompt(F.col("docs"), F.col("question"), config.qa_topk))
    answers = ask(rows.withColumn("messages", chat(prompt, prompt_user=F.col("prompt"))), model, tables)
    return answers.withColumn("answer", parse_answer(F.col("response")))


def next_thought(model: ChatModel, prompt: list[dict[str, str]], question: str, passages: list[str], thoughts: list[str]) -> str:
    """One step of interleaved retrieval and reasoning; a thought that holds "So the answer is:" is the last."""
    user = "".join(f"Wikipedia Title: {p}\n\n" for p in passages) + f"Question: {question}\nThought: " + " ".join(thoughts)
    return model.infer([*prompt, {"role": "user", "content": user}])[0]
