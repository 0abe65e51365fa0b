"""Calls to a chat model as a table: one row a prompt, answered from a cache or by the model.

Prompts, parsing and counting are columns; only the calls themselves run in
Python, on the executors, as many at once in a task as the model allows. The
answers are written once, so no later step calls again, and a call that fails
is a row with an error, not the end of the job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lorewell import schemas
from lorewell.operators.models import ChatModel
from lorewell.scratch import materialize
from lorewell.sources.files import Tables, cache_key, through_cache

FIELD = re.compile(r"\$\{(\w+)\}")
ANSWERS = pa.schema([(c, pa.string()) for c in ("key", "message", "metadata", "error")])
METADATA = "prompt_tokens long, completion_tokens long, finish_reason string"


def chat(template: list[dict[str, str]], **fields: Column) -> Column:
    """The messages of a template (role, content with ``${name}`` fields) as a column; a null field is empty."""
    messages = []
    for m in template:
        parts = FIELD.split(m["content"])  # texts and, at odd places, names of fields
        filled = [F.lit(x) if k % 2 == 0 else F.coalesce(fields[x], F.lit("")) for k, x in enumerate(parts)]
        messages.append(F.struct(F.lit(m["role"]).alias("role"), F.concat(*filled).alias("content")))
    return F.array(*messages)


def _answer(model: ChatModel, batch: list[list[dict[str, str]]], options: dict[str, Any]) -> Iterator[tuple[str | None, str | None, str | None]]:
    """message, metadata and error of each prompt; models with ``infer_batch`` get all prompts at once."""
    if hasattr(model, "infer_batch"):
        try:
            yield from ((text, json.dumps(meta), None) for text, meta in model.infer_batch(batch, **options))
        except Exception as e:  # noqa: BLE001  whatever a model raises, the rows say so
            yield from ((None, None, repr(e)) for _ in batch)
        return

    def one(messages: list[dict[str, str]]) -> tuple[str | None, str | None, str | None]:
        try:
            text, meta = model.infer(messages, **options)
            return text, json.dumps(meta), None
        except Exception as e:  # noqa: BLE001
            return None, None, repr(e)

    with ThreadPoolExecutor(max(1, getattr(model, "parallel", 1))) as pool:
        yield from pool.map(one, batch)


def ask(prompts: DataFrame, model: ChatModel, tables: Tables | None = None, schema: dict[str, Any] | None = None) -> DataFrame:
    """``prompts`` (any columns and ``messages``) with response, finish_reason, prompt_tokens, completion_tokens, cache_hit, error.

    Equal prompts are one call. With ``tables`` answers are kept in the table
    "llm_cache" there and asked for once ever; failed calls aren't kept.
    ``schema`` is the JSON schema of the response, for models that can be held to one.
    """
    settings = {k: getattr(model, k, v) for k, v in {"model": type(model).__name__, "seed": None, "temperature": 0.0}.items()}
    options = {"schema": schema} if schema and getattr(model, "guided", False) else {}
    keyed = materialize(prompts.withColumn("key", cache_key(F.col("messages"), settings["model"], settings["seed"], settings["temperature"])), "prompts")

    def run(todo: DataFrame) -> DataFrame:
        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = list(_answer(model, b.column("messages").to_pylist(), options))
                    yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(c, pa.string()) for c in zip(*found)]], schema=ANSWERS)

        return todo.select("key", "messages").mapInArrow(answer, "key string, message string, metadata string, error string")

    cache = tables.read("llm_cache", schemas.LLM_CACHE) if tables else prompts.sparkSession.createDataFrame([], schemas.LLM_CACHE)
    answers, fresh = through_cache(keyed, cache, run)
    if tables:
        good = fresh.where("error is null").select("key", "message", "metadata")
        if not good.isEmpty():
            tables.replace("llm_cache", cache.unionByName(good))
    meta = F.from_json("metadata", METADATA)
    found = answers.select("key", F.col("message").alias("response"), *[meta[c].alias(c) for c in ("finish_reason", "prompt_tokens", "completion_tokens")], "cache_hit", "error")
    return keyed.join(found, "key").drop("key", "messages")


def usage(calls: DataFrame) -> DataFrame:
    """One row of counters of answered calls: calls, tokens, cache hits, failures."""
    return calls.agg(
        F.count(F.lit(1)).alias("num_calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"), F.count_if("cache_hit").alias("num_cache_hit"),
        F.count_if(F.col("error").isNotNull()).alias("num_failed"),
    )
